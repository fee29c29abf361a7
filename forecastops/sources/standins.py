"""Stand-in tables: the nine table roles derived from the given star schema.

The derivations inject the awkward values the roles must cope with: missing and zero weather, counts that
are no numbers, missing vehicle classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecastops.functions import month_key, week_bucket

CARRIERS = ["af", "ao", "nf", "no", "rf", "ro"]
WEATHER = ["awnd", "prcp", "snow", "snwd", "tmax", "tmin"]
VEHICLES = ["auto", "small_trucks", "large_trucks", "busses"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane-minute vehicle counts, one vehicle class filled per row."""
    def vehicle_class(i):
        return F.when(F.col("event_id") % 4 == i, F.floor("value").cast("bigint"))

    return _table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"),
        (F.col("user_id") % 8).cast("int").alias("lane"),
        (F.hour("ts") * 100 + F.minute("ts")).cast("int").alias("time"),
        F.col("event_type").alias("facility"),
        *[vehicle_class(i).alias(v) for i, v in enumerate(VEHICLES)])


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather; days may repeat where both sources cover them."""
    def daily(table, when, value, scale):
        day = F.to_date(when).alias("d")
        return _table(spark, sf_dir, table).groupBy(day).agg(
            F.count(F.lit(1)).alias("n"), (F.max(value) * scale).alias("mx"), (F.min(value) * scale).alias("mn"))

    days = daily("orders", "o_orderdate", "o_totalprice", 1).unionByName(daily("events", "ts", "value", 1000))
    dom, month = F.dayofmonth("d"), F.month("d")
    return days.select(
        F.col("d").alias("date"),
        F.when(dom % 9 != 0, F.floor(F.col("mx") / 1000).cast("double")).alias("awnd"),
        (F.col("n") % 5).cast("double").alias("prcp"),
        F.when(month.isin(12, 1, 2), (F.col("n") % 7).cast("double")).otherwise(0.0).alias("snow"),
        F.when(dom % 10 != 0, (F.col("n") % 3).cast("double")).alias("snwd"),
        F.floor(F.col("mx") / 5000).cast("double").alias("tmax"),
        F.floor(F.col("mn") / 5000).cast("double").alias("tmin"))


def _by_carrier(value):
    """One sum per (return flag, line status) pair, named by the two letters."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return [F.sum(F.when((flag == c[0].upper()) & (status == c[1].upper()), value)).cast("bigint").alias(c)
            for c in CARRIERS]


def carrier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures per day, one column per carrier."""
    return _table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        *_by_carrier(F.col("l_quantity")), F.sum("l_quantity").cast("bigint").alias("total"))


def _weekly(spark, sf_dir, value, total):
    start = week_bucket("l_shipdate").alias("start_date")
    weeks = _table(spark, sf_dir, "lineitem").groupBy(start).agg(
        *_by_carrier(value), F.sum(value).cast("bigint").alias(total))
    return weeks.select("start_date", F.date_add("start_date", 6).alias("end_date"), *CARRIERS, total)


def passenger_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir, F.col("l_quantity"), "total")


def bus_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir, F.lit(1), "bus_total")


def passenger_bus_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    buses = bus_weekly(spark, sf_dir)
    buses = buses.select("start_date", "end_date", "bus_total", *[F.col(c).alias(f"bus_{c}") for c in CARRIERS])
    joined = passenger_weekly(spark, sf_dir).join(buses, ["start_date", "end_date"])
    return joined.select("start_date", "total", "bus_total", *CARRIERS, *[f"bus_{c}" for c in CARRIERS])


def _terminal(spark, sf_dir, status):
    n, top = F.count(F.lit(1)), F.floor(F.max("o_totalprice")).cast("bigint")
    return (_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status)
            .groupBy(month_key(F.to_date("o_orderdate")).alias("date"), F.col("o_orderpriority").alias("route"))
            .agg(F.when(n % 11 == 0, "n/a").otherwise(n.cast("string")).alias("buses_count"),
                 F.when(n % 13 == 0, "").otherwise(top.cast("string")).alias("passengers_count")))


def terminal_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips by month text and route, counts as raw text."""
    return _terminal(spark, sf_dir, "F")


def terminal_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terminal(spark, sf_dir, "O")


def traffic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane-hour traffic over many years."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        day.alias("date"),
        (F.col("o_custkey") % 8).cast("int").alias("lane"),
        (key % 24).cast("int").alias("time"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("total"),
        (key % 97).alias("class_1"), (key % 13).alias("class_9"), (key % 5).alias("buses"),
        F.col("o_orderstatus").alias("fac_b"), F.col("o_orderpriority").alias("fac_g"),
        F.when(F.weekday(day) == 0, "Monday").otherwise("Other").alias("day_name"))


ROLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (traffic, weather, carrier_daily, terminal_a, terminal_b, passenger_weekly, bus_weekly,
                            passenger_bus_weekly, traffic_history)
}
