"""Calendar spines and the future grid. Rows come from ``sequence`` + ``explode``, not from a driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _as(value, kind: str) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(kind)


def month_spine(spark: SparkSession, start, end) -> DataFrame:
    """``month_start, year, month`` for every month from ``start`` to ``end``; bounds may be scalar subqueries."""
    first, last = F.trunc(_as(start, "date"), "month"), F.trunc(_as(end, "date"), "month")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    out = spark.range(1).select(F.explode(months).alias("month_start"))
    return out.select("month_start", F.year("month_start").alias("year"), F.month("month_start").alias("month"))


def hour_spine(spark: SparkSession, start, end) -> DataFrame:
    """``ts`` for every hour from ``start`` to ``end``.

    Days are exploded first and hours inside each day after, so no single array holds the whole span.
    """
    first, last = _as(start, "timestamp_ntz"), _as(end, "timestamp_ntz")
    days = F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    out = (spark.range(1).select(first.alias("first"), last.alias("last"), F.explode(days).alias("day"))
           .select("first", "last", "day", hours.alias("h"))
           .withColumn("ts", F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))))
    return out.filter((F.col("ts") >= F.col("first")) & (F.col("ts") <= F.col("last"))).select("ts")


def series_months(series: DataFrame, start, end) -> DataFrame:
    """Every row of ``series`` repeated for every month: the forecast horizon of many series at once."""
    months = F.sequence(F.trunc(_as(start, "date"), "month"), F.trunc(_as(end, "date"), "month"),
                        F.expr("interval 1 month"))
    out = series.withColumn("month_start", F.explode(months))
    return out.withColumn("year", F.year("month_start")).withColumn("month", F.month("month_start"))


def series_days(series: DataFrame, start, end) -> DataFrame:
    """Every row of ``series`` repeated for every day ``start``..``end``."""
    return series.withColumn("date", F.explode(F.sequence(_as(start, "date"), _as(end, "date"), F.expr("interval 1 day"))))


def day_hours(days: DataFrame) -> DataFrame:
    """Every row repeated for the 24 hours of its ``date``."""
    return (days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
            .withColumn("ts", F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"))))


def future_grid(df: DataFrame, years: tuple[int, int], time: str = "time", facility: str = "facility") -> DataFrame:
    """All combinations of year, month, observed time of day and observed facility.

    The facility list stays distributed. The times of day are one array with at most 1,440 entries, read
    through a scalar subquery, and years and months are generated per row, so the plan has no cross join.
    """
    times = df.select(time).distinct().agg(F.array_sort(F.collect_list(time)).alias("times"))
    facilities = df.select(facility).filter(F.col(facility).isNotNull()).distinct()
    return (facilities
            .withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
            .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .withColumn(time, F.explode(times.scalar()))
            .select("year", "month", time, facility))
