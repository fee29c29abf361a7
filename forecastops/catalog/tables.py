"""Derived tables shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.functions import hhmm_hour, row_total
from forecastops.operators.aggregates import sum_by
from forecastops.sources import standins as t


def _at_hour(date: str, hour):
    return F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def traffic_hourly(spark: SparkSession, d: str) -> DataFrame:
    """``facility, ts, total_vehicles`` per hour of the recent traffic."""
    rows = t.traffic(spark, d).select("facility", _at_hour("date", hhmm_hour("time")).alias("ts"),
                                      row_total(t.VEHICLES).alias("n"))
    return rows.groupBy("facility", "ts").agg(F.sum("n").alias("total_vehicles"))


def history_hourly(spark: SparkSession, d: str) -> DataFrame:
    """``facility, ts, total_vehicles`` per hour of the traffic history."""
    rows = t.traffic_history(spark, d).select(F.col("fac_g").alias("facility"), _at_hour("date", F.col("time")).alias("ts"), "total")
    return rows.groupBy("facility", "ts").agg(F.sum("total").alias("total_vehicles"))


def carrier_monthly(spark: SparkSession, d: str) -> DataFrame:
    """``year, month`` and the monthly sum of every carrier."""
    days = t.carrier_daily(spark, d).withColumns({"year": F.year("date"), "month": F.month("date")})
    return sum_by(days, ["year", "month"], [*t.CARRIERS, "total"])


def rounded(df: DataFrame, cols, digits: int = 4) -> DataFrame:
    """Means rounded for comparison; adding zero removes a negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})
