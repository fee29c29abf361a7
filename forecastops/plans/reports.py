"""The fourteen monthly and row-level reports.

Each function takes the tables it reads and returns an unsorted DataFrame; :func:`ordered` adds the
report order at the export boundary. Sums over joins are computed from per-key sums and counts wherever
the report asks for totals only, so no report builds joined rows just to add them up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecastops.functions import month_key, month_text, to_count, to_number, valid_month_text, year_text
from forecastops.operators.aggregates import max_by_group, sum_by
from forecastops.operators.joins import (calendar_side, join_sums, measured_side, prefix_columns, right_join_chain, spine_join,
                                         spread_join, star_join)
from forecastops.operators.ordered import first_per_group
from forecastops.sources.standins import CARRIERS, WEATHER

MONTH = ["year", "month"]


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report order; missing values come first.

    Rows that agree on ``keys`` are ordered by a hash of the whole row. The order is then fine enough for
    the range shuffle to spread a hot key over several tasks.
    """
    return df.orderBy(*[F.asc_nulls_first(k) for k in keys], F.xxhash64(*df.columns))


def _year_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumns({"year": F.year(date), "month": F.month(date)})


def _month_of_text(df: DataFrame, text: str) -> DataFrame:
    """Calendar numbers of a ``yyyy-MM`` text; rows whose text is no month are left out."""
    key = valid_month_text(text)
    return df.filter(key.isNotNull()).withColumns(
        {"year": F.substring(key, 1, 4).cast("int"), "month": F.substring(key, 6, 2).cast("int")})


def weather_by_month(weather: DataFrame, cols: Sequence[str] = WEATHER) -> DataFrame:
    """Monthly maxima of the weather columns."""
    return max_by_group(_year_month(weather, "date"), MONTH, cols)


def text_months(df: DataFrame, date: str) -> DataFrame:
    """Year and month as text, the key of the facility reports."""
    return df.withColumns({"year": year_text(date), "month": month_text(date)})


def _month_counts(df: DataFrame, date: str, sums: dict[str, str]) -> DataFrame:
    """Monthly sums of safely cast counts. Only real months are kept, since nothing else can meet a spine
    made of dates; this also bounds the result by the calendar."""
    rows = text_months(df.filter(valid_month_text(date).isNotNull()), date)
    return rows.groupBy(*MONTH).agg(*[F.sum(to_count(c)).alias(name) for name, c in sums.items()])


def carriers_with_terminal_and_weather(carrier: DataFrame, terminal: DataFrame, weather: DataFrame,
                                       carriers: Sequence[str] = CARRIERS, total: str = "total") -> DataFrame:
    """Report 1: monthly carrier sums with terminal totals and weather maxima.

    The fact side is summed to months before it meets the two monthly tables, which have one row per
    month; the result is the same and no daily row is shuffled for a join.
    """
    facts = sum_by(_year_month(carrier, "date"), MONTH, [*carriers, total])
    terminals = _month_of_text(terminal, "date").groupBy(*MONTH).agg(
        F.sum(to_count("buses_count")).alias("total_buses"), F.sum(to_count("passengers_count")).alias("total_passengers"))
    return (facts.join(calendar_side(terminals), MONTH, "left")
            .join(calendar_side(weather_by_month(weather)), MONTH, "left"))


def facility_months_right_chain(history: DataFrame, terminal_a: DataFrame, terminal_b: DataFrame, departures: DataFrame,
                                facility: str = "fac_g") -> DataFrame:
    """Report 2: facility-month spine through three right joins with safe casts."""
    spine = text_months(history, "date").select(*MONTH, facility).distinct()
    a = text_months(terminal_a, "date").select(*MONTH, to_count("buses_count").alias("a_buses"),
                                               to_count("passengers_count").alias("a_passengers"))
    b = text_months(terminal_b, "date").select(*MONTH, to_count("buses_count").alias("b_buses"),
                                               to_count("passengers_count").alias("b_passengers"))
    d = text_months(departures, "start_date").select(*MONTH, to_count("total").alias("d_total"),
                                                     to_count("bus_total").alias("d_bus_total"))
    return right_join_chain(spine, [a, b, d], MONTH)


def facility_hours_with_counts(history: DataFrame, terminal_a: DataFrame, terminal_b: DataFrame, departures: DataFrame,
                               weather: DataFrame, facility: str = "fac_g", time: str = "time") -> DataFrame:
    """Report 3: facility-hour-month spine, three monthly sums and the weather of the first day of the month.

    The spine is distinct and every joined table has one row per month, so the joined result is free of
    duplicates without a second pass.
    """
    spine = text_months(history, "date").select(*MONTH, facility, time).distinct()
    first_day = first_per_group(text_months(weather.filter(F.col("date").isNotNull()), "date"), MONTH, ["date"]).select(
        *MONTH, *[to_number(c).alias(c) for c in WEATHER])
    return spine_join(spine, [
        _month_counts(terminal_a, "date", {"a_passengers": "passengers_count"}),
        _month_counts(terminal_b, "date", {"b_passengers": "passengers_count"}),
        _month_counts(departures, "start_date", {"d_passengers": "total"}), first_day], MONTH)


def _passenger_bus_months(passengers: DataFrame, buses: DataFrame, carriers: Sequence[str]) -> DataFrame:
    weeks = join_sums(passengers, buses, ["start_date", "end_date"],
                      {f"passenger_{c}": F.col(c) for c in carriers}, {f"bus_{c}": F.col(c) for c in carriers})
    cols = [f"{side}_{c}" for c in carriers for side in ("passenger", "bus")]
    return sum_by(_year_month(weeks, "start_date"), MONTH, cols)


def passengers_with_buses(passengers: DataFrame, buses: DataFrame, carriers: Sequence[str] = CARRIERS) -> DataFrame:
    """Report 4: monthly sums over passengers joined with buses on both week dates."""
    return _passenger_bus_months(passengers, buses, carriers)


def passengers_with_buses_rows(passengers: DataFrame, buses: DataFrame, carriers: Sequence[str] = CARRIERS) -> DataFrame:
    """Report 5: the same at row level, joined on the start date only."""
    p = passengers.select("start_date", *[F.col(c).alias(f"passenger_{c}") for c in carriers])
    b = buses.select("start_date", *[F.col(c).alias(f"bus_{c}") for c in carriers])
    cols = [f"{side}_{c}" for c in carriers for side in ("passenger", "bus")]
    return _year_month(p.join(b, "start_date"), "start_date").select(*MONTH, *cols)


def carriers_with_terminal_sums(carrier: DataFrame, terminal: DataFrame, carriers: Sequence[str] = CARRIERS,
                                total: str = "total", fanout: str = "keep") -> DataFrame:
    """Report 6: monthly sums of daily carriers joined with monthly terminal rows.

    Every daily row meets every route row of its month, so sums are multiplied by the number of rows on
    the other side. That is the report as asked for (``fanout="keep"``) and is computed from per-month
    sums and counts. ``fanout="preaggregate"`` gives each side's own totals instead.
    """
    key = "__month"
    left = carrier.withColumn(key, month_key("date")).filter(F.col(key).isNotNull())
    right = terminal.withColumn(key, valid_month_text("date")).filter(F.col("date") == F.col(key))
    l_sums = {c: F.col(c) for c in [*carriers, total]}
    r_sums = {"total_buses": to_count("buses_count"), "total_passengers": to_count("passengers_count")}
    if fanout == "keep":
        months = join_sums(left, right, [key], l_sums, r_sums)
    else:
        months = left.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in l_sums.items()]).join(
            right.groupBy(key).agg(*[F.sum(c).alias(n) for n, c in r_sums.items()]), key)
    return months.select(F.substring(key, 1, 4).cast("int").alias("year"), F.substring(key, 6, 2).cast("int").alias("month"),
                         *l_sums, *r_sums)


def carriers_with_terminal_rows(carrier: DataFrame, terminal: DataFrame, carriers: Sequence[str] = CARRIERS,
                                total: str = "total") -> DataFrame:
    """Report 7: the joined rows of report 6."""
    left = _year_month(carrier, "date").select(*MONTH, *carriers, total, month_key("date").alias("__month"))
    right = terminal.select(F.col("date").alias("__month"), "buses_count", "passengers_count")
    return spread_join(left, right, ["__month"], "inner").drop("__month")


def four_table_star(carrier: DataFrame, terminal_b: DataFrame, terminal_a: DataFrame, departures: DataFrame) -> DataFrame:
    """Report 8: daily carriers with every monthly row of three tables, all columns, prefixed by source."""
    return star_join(carrier, month_key("date"), {
        "b_": (terminal_b, F.col("date")), "a_": (terminal_a, F.col("date")),
        "d_": (departures, month_key("start_date"))})


def four_table_star_chosen(carrier: DataFrame, terminal_b: DataFrame, terminal_a: DataFrame, departures: DataFrame) -> DataFrame:
    """Report 9: report 8 with chosen columns; the rest is pruned from the scans."""
    star = four_table_star(carrier, terminal_b, terminal_a, departures)
    return star.select("date", "af", "nf", "ro", "b_route", "b_buses_count", "b_passengers_count", "a_route",
                       "a_buses_count", "a_passengers_count", "d_start_date", "d_total", "d_bus_total", "d_af", "d_bus_af")


def facility_months_with_counts(history: DataFrame, terminal_a: DataFrame, terminal_b: DataFrame, departures: DataFrame,
                                facility: str = "fac_g") -> DataFrame:
    """Report 10: facility-month spine with three pre-aggregated tables."""
    spine = text_months(history, "date").select(*MONTH, facility).distinct()
    return spine_join(spine, [
        _month_counts(terminal_a, "date", {"a_buses": "buses_count", "a_passengers": "passengers_count"}),
        _month_counts(terminal_b, "date", {"b_buses": "buses_count", "b_passengers": "passengers_count"}),
        _month_counts(departures, "start_date", {"d_total": "total", "d_bus_total": "bus_total"})], MONTH)


def traffic_with_weather(traffic: DataFrame, weather: DataFrame, cols: Sequence[str] = WEATHER) -> DataFrame:
    """Report 11: traffic rows with the weather of their day. The daily table is broadcast once its size
    has been checked; otherwise both sides are sorted by date and hot dates are split."""
    side = prefix_columns(weather.select("date", *cols), "w_", keep=("date",))
    return traffic.join(measured_side(side), "date", "left")


def traffic_with_weather_chosen(traffic: DataFrame, weather: DataFrame) -> DataFrame:
    """Report 12: report 11 with chosen columns, ordered by date."""
    out = traffic_with_weather(traffic, weather).select(
        "date", "lane", "time", "total", "class_1", "class_9", "fac_b", "buses", "fac_g", "day_name",
        *[F.col(f"w_{c}").alias(c) for c in WEATHER])
    return ordered(out, ["date"])


def traffic_month_summary(traffic: DataFrame, weather: DataFrame) -> DataFrame:
    """Report 13: monthly counts, sums, means and samples over traffic joined with daily weather.

    Traffic and weather are first reduced to one row per day, then combined by day: a day with several
    weather rows counts its traffic that many times, as the row join would.
    """
    def present(c):
        return F.col(c).isNotNull().cast("bigint")

    averaged_t, summed_t = ["lane", "time"], ["total", "class_1", "class_9", "buses"]
    averaged_w, summed_w = ["awnd", "tmax", "tmin"], ["prcp", "snow", "snwd"]
    t_sums = ({c: F.col(c).cast("bigint") for c in [*averaged_t, *summed_t]} | {f"n_{c}": present(c) for c in averaged_t})
    w_sums = {c: F.col(c) for c in [*averaged_w, *summed_w]} | {f"n_{c}": present(c) for c in averaged_w}
    samples = {f"sample_{c}": F.col(c) for c in ("fac_b", "fac_g", "day_name")}
    days = join_sums(traffic, weather, ["date"], t_sums, w_sums, "left", samples)
    joined = _year_month(days, "date").groupBy(*MONTH).agg(
        F.sum("joined_rows").alias("record_count"), *[F.sum(c).alias(c) for c in [*t_sums, *w_sums]], *[F.max(c).alias(c) for c in samples])

    def mean(c, name):
        return F.try_divide(F.col(c).cast("double"), F.col(f"n_{c}")).alias(name)

    return joined.select(
        "year", "month", "record_count",
        mean("lane", "avg_lane"), mean("time", "avg_time"), F.col("total").alias("total_vehicles"),
        F.col("class_1").alias("total_class_1"), F.col("class_9").alias("total_class_9"), "sample_fac_b",
        F.col("buses").alias("total_buses"), "sample_fac_g", "sample_day_name", mean("awnd", "avg_wind_speed"),
        F.col("prcp").alias("total_precipitation"), F.col("snow").alias("total_snowfall"),
        F.col("snwd").alias("total_snow_depth"), mean("tmax", "avg_tmax"), mean("tmin", "avg_tmin"))


def passengers_buses_weather(passengers: DataFrame, buses: DataFrame, weather: DataFrame,
                             carriers: Sequence[str] = CARRIERS) -> DataFrame:
    """Report 14: report 4 with the weather maxima of the month."""
    months = _passenger_bus_months(passengers, buses, carriers)
    return months.join(calendar_side(weather_by_month(weather)), MONTH, "left")
