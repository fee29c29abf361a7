"""Year-against-year comparison and time profiles.

All comparisons start from one small cube: sums and counts per facility, year, month, week, day type and
hour. The fact table is shuffled once, as partial aggregates, and every mean below is a ratio of sums of
that cube.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastops.functions import day_type, half_even, month_bucket, percent_change, trend_label, week_bucket
from forecastops.operators.aggregates import pivot_sum
from forecastops.session import cut_lineage

SUMMER = (6, 7, 8)
CUBE_KEYS = ["facility", "year", "month", "week", "day_type", "hour"]


def calendar_cube(df: DataFrame, value: str = "total_vehicles", ts: str = "ts", keys: Sequence[str] = CUBE_KEYS) -> DataFrame:
    """Sum and count of ``value`` per facility and calendar part. ``keys`` may be a subset."""
    parts = {"year": F.year(ts), "month": F.month(ts), "week": week_bucket(ts), "day_type": day_type(ts),
             "hour": F.hour(ts)}
    rows = df.select("facility", *[e.alias(k) for k, e in parts.items() if k in keys], F.col(value).alias("__v"))
    rows = rows.dropna(subset=[k for k in keys])
    return rows.groupBy(*keys).agg(F.sum("__v").alias("__sum"), F.count("__v").alias("__n"))


def cube_mean(cube: DataFrame, by: Sequence[str], name: str = "mean_value") -> DataFrame:
    """Mean per ``by``, rolled up from a cube."""
    return cube.groupBy(*by).agg(F.try_divide(F.sum("__sum"), F.sum("__n")).cast("double").alias(name))


def year_pair(actual: DataFrame, forecast: DataFrame, base: int, target: int, value: str = "total_vehicles",
              ts: str = "ts") -> DataFrame:
    """Rows of the base year from the history and of the target year from the forecast, in one table."""
    def year_rows(df, y):
        inside = ((F.col(ts) >= F.lit(f"{y:04d}-01-01").cast("timestamp_ntz"))
                  & (F.col(ts) < F.lit(f"{y + 1:04d}-01-01").cast("timestamp_ntz")))
        return df.filter(inside).select("facility", F.col(ts).alias("ts"), F.col(value).cast("double").alias(value))

    return year_rows(actual, base).unionByName(year_rows(forecast, target))


def profile(df: DataFrame, bucket: str, value: str = "total_vehicles", ts: str = "ts") -> DataFrame:
    """Mean per facility and week, month (both as start dates) or year."""
    start = {"week": week_bucket(ts), "month": month_bucket(ts), "year": F.year(ts)}[bucket]
    return (df.filter(F.col("facility").isNotNull() & F.col(ts).isNotNull())
            .groupBy("facility", start.alias(bucket)).agg(F.avg(value).alias("mean_value")))


def mark_holidays(weekly: DataFrame, week: str = "week", name: str = "holiday_week") -> DataFrame:
    """1 for weeks that hold January 1 or December 25."""
    monday, sunday = F.col(week), F.date_add(week, 6)
    christmas = F.make_date(F.year(monday), F.lit(12), F.lit(25))
    new_year = F.make_date(F.year(sunday), F.lit(1), F.lit(1))
    return weekly.withColumn(name, (christmas.between(monday, sunday) | new_year.between(monday, sunday)).cast("int"))


def year_change(cube: DataFrame, base: int, target: int, digits: int = 2) -> DataFrame:
    """Means of two years per facility with percent change and trend; both years must be present."""
    means = pivot_sum(cube_mean(cube, ["facility", "year"]), ["facility"], "year",
                      {base: "avg_base", target: "avg_target"}, "mean_value").dropna()
    change = half_even(percent_change("avg_base", "avg_target"), digits)
    return means.withColumn("percent_change", change).withColumn("trend", trend_label("percent_change"))


def summer_change(cube: DataFrame, base: int, target: int) -> DataFrame:
    """Mean of the June to August monthly means in both years and the direction of change."""
    monthly = cube_mean(cube.filter(F.col("month").isin(*SUMMER)), ["facility", "year", "month"])
    out = monthly.groupBy("facility").agg(
        F.avg(F.when(F.col("year") == base, F.col("mean_value"))).alias("summer_base"),
        F.avg(F.when(F.col("year") == target, F.col("mean_value"))).alias("summer_target")).dropna()
    out = out.withColumn("summer_change", percent_change("summer_base", "summer_target"))
    c = F.col("summer_change")
    return out.withColumn("summer_trend", F.when(c > 0, "Increase").when(c < 0, "Decrease").otherwise("-"))


def rush_label(change: Column) -> Column:
    """Below 5 % either way is flattened, above is sharpened; what remains, +5 % itself included, is reduced."""
    return F.when(F.abs(change) < 5, "Flattened").when(change > 5, "Sharpened").otherwise("Reduced")


def rush_hour_change(cube: DataFrame, base: int, target: int) -> DataFrame:
    """Change of the busiest weekday hour between two years."""
    hourly = cube_mean(cube.filter(F.col("day_type") == "Weekday"), ["facility", "year", "hour"])
    out = hourly.groupBy("facility").agg(
        F.max(F.when(F.col("year") == base, F.col("mean_value"))).alias("rush_base"),
        F.max(F.when(F.col("year") == target, F.col("mean_value"))).alias("rush_target")).dropna()
    out = out.withColumn("rush_change", percent_change("rush_base", "rush_target"))
    return out.withColumn("rush_trend", rush_label(F.col("rush_change")))


def recovery_summary(cube: DataFrame, base: int, target: int) -> DataFrame:
    """One row per facility: year change with summer and rush-hour trends where both years have them.

    The cube feeds three comparisons and is written out once, so the facts are read once.
    """
    cube = cut_lineage(cube)
    return (year_change(cube, base, target)
            .join(summer_change(cube, base, target), "facility", "left")
            .join(rush_hour_change(cube, base, target), "facility", "left"))
