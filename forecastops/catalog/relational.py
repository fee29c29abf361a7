"""Joins, aggregates, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastops import functions as fn
from forecastops.catalog.registry import query
from forecastops.catalog.reports import TERMINAL_MONTH, WEATHER_MONTH
from forecastops.catalog.tables import carrier_monthly, history_hourly, rounded, traffic_hourly
from forecastops.operators import aggregates as agg
from forecastops.operators import joins as j
from forecastops.operators.prepare import attach_climatology, hourly_by_facility
from forecastops.operators.quantiles import exact_quantiles
from forecastops.operators.segments import day_type_profile
from forecastops.plans import reports as r
from forecastops.sources import spines
from forecastops.sources import standins as t

C6, W6, V4 = t.CARRIERS, t.WEATHER, t.VEHICLES


# --- joins -------------------------------------------------------------------------------------------

@query("join_inner_2key", f"""SELECT p.start_date, p.end_date, p.total, b.bus_total
FROM passenger_weekly p JOIN bus_weekly b ON p.start_date = b.start_date AND p.end_date = b.end_date""")
def join_inner_2key(spark, d):
    p = t.passenger_weekly(spark, d).select("start_date", "end_date", "total")
    return p.join(t.bus_weekly(spark, d).select("start_date", "end_date", "bus_total"), ["start_date", "end_date"])


@query("join_inner_1key", "SELECT p.start_date, p.af, b.af AS bus_af FROM passenger_weekly p JOIN bus_weekly b ON p.start_date = b.start_date")
def join_inner_1key(spark, d):
    p = t.passenger_weekly(spark, d).select("start_date", "af")
    return p.join(t.bus_weekly(spark, d).select("start_date", F.col("af").alias("bus_af")), "start_date")


@query("join_left_derived", f"""WITH tm AS ({TERMINAL_MONTH})
SELECT c.date, c.total, tm.total_buses, tm.total_passengers FROM carrier_daily c
LEFT JOIN tm ON year(c.date) = tm.year AND month(c.date) = tm.month""")
def join_left_derived(spark, d):
    months = t.terminal_a(spark, d).filter(fn.valid_month_text("date").isNotNull()).groupBy(fn.month_start_of_text("date").alias("ms")).agg(
        F.sum(fn.to_count("buses_count")).alias("total_buses"), F.sum(fn.to_count("passengers_count")).alias("total_passengers"))
    keys = {"__y": (F.year("date"), F.year("ms")), "__m": (F.month("date"), F.month("ms"))}
    return j.join_derived(t.carrier_daily(spark, d).select("date", "total"), j.calendar_side(months), keys).drop("__y", "__m", "ms")


@query("join_left_date", "SELECT h.date, h.lane, h.time, h.total, w.awnd, w.tmax FROM traffic_history h LEFT JOIN weather w ON h.date = w.date")
def join_left_date(spark, d):
    side = t.weather(spark, d).select("date", "awnd", "tmax")
    return t.traffic_history(spark, d).select("date", "lane", "time", "total").join(j.measured_side(side), "date", "left")


@query("join_month_text", """SELECT c.date, c.total, a.route, a.buses_count FROM carrier_daily c
JOIN terminal_a a ON strftime(c.date, '%Y-%m') = a.date""")
def join_month_text(spark, d):
    left = t.carrier_daily(spark, d).select("date", "total")
    right = t.terminal_a(spark, d).select(F.col("date").alias("month_text"), "route", "buses_count")
    left, right = left.withColumn("__month", F.date_format("date", "yyyy-MM")), right.withColumnRenamed("month_text", "__month")
    return j.spread_join(left, right, ["__month"], "inner").drop("__month")


@query("join_star_month", """SELECT c.date, c.total, a.route AS a_route, a.buses_count AS a_buses_count, d.start_date AS d_start_date, d.bus_total AS d_bus_total
FROM carrier_daily c LEFT JOIN terminal_a a ON a.date = substring(CAST(c.date AS VARCHAR),1,7)
LEFT JOIN passenger_bus_weekly d ON strftime(d.start_date, '%Y-%m') = substring(CAST(c.date AS VARCHAR),1,7)""")
def join_star_month(spark, d):
    return j.star_join(t.carrier_daily(spark, d).select("date", "total"), fn.month_key("date"), {
        "a_": (t.terminal_a(spark, d).select("date", "route", "buses_count"), F.col("date")),
        "d_": (t.passenger_bus_weekly(spark, d).select("start_date", "bus_total"), fn.month_key("start_date"))}).drop("a_date")


@query("join_right_chain", """WITH td AS (SELECT DISTINCT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month FROM traffic_history WHERE year(date) < 1999)
SELECT td.year, td.month, a.route, a.buses_count, d.start_date, d.total FROM td
RIGHT JOIN terminal_a a ON td.year = substring(a.date,1,4) AND td.month = substring(a.date,6,2)
RIGHT JOIN passenger_weekly d ON td.year = strftime(d.start_date, '%Y') AND td.month = strftime(d.start_date, '%m')""")
def join_right_chain(spark, d):
    keys = ["year", "month"]
    history = t.traffic_history(spark, d).filter(fn.year_range("date", 1, 1998))
    spine = r.text_months(history, "date").select(*keys).distinct()
    a = r.text_months(t.terminal_a(spark, d), "date").select(*keys, "route", "buses_count")
    p = r.text_months(t.passenger_weekly(spark, d), "start_date").select(*keys, "start_date", "total")
    return j.right_join_chain(spine, [a, p], keys)


@query("join_right_chain_whole", """WITH td AS (SELECT DISTINCT strftime(date, '%Y') AS year, strftime(date, '%m') AS month FROM traffic_history)
SELECT td.year, td.month, a.route, a.buses_count, d.start_date, d.total FROM td
RIGHT JOIN terminal_a a ON td.year = substring(a.date,1,4) AND td.month = substring(a.date,6,2)
RIGHT JOIN passenger_weekly d ON td.year = strftime(d.start_date, '%Y') AND td.month = strftime(d.start_date, '%m')""")
def join_right_chain_whole(spark, d):
    """The chain over the whole history; weeks after its last month give the null rows."""
    keys = ["year", "month"]
    spine = r.text_months(t.traffic_history(spark, d), "date").select(*keys).distinct()
    a = r.text_months(t.terminal_a(spark, d), "date").select(*keys, "route", "buses_count")
    p = r.text_months(t.passenger_weekly(spark, d), "start_date").select(*keys, "start_date", "total")
    return j.right_join_chain(spine, [a, p], keys)


@query("join_preagg_multi", f"""WITH wm AS ({WEATHER_MONTH}), tm AS ({TERMINAL_MONTH})
SELECT c.year, c.month, c.total, tm.total_buses, wm.tmax FROM carrier_monthly c
LEFT JOIN tm ON c.year = tm.year AND c.month = tm.month LEFT JOIN wm ON c.year = wm.year AND c.month = wm.month""")
def join_preagg_multi(spark, d):
    a = t.terminal_a(spark, d).filter(fn.valid_month_text("date").isNotNull()).groupBy(
        F.substring("date", 1, 4).cast("int").alias("year"), F.substring("date", 6, 2).cast("int").alias("month")).agg(
        F.sum(fn.to_count("buses_count")).alias("total_buses"))
    w = r.weather_by_month(t.weather(spark, d), ["tmax"])
    return j.spine_join(carrier_monthly(spark, d).select("year", "month", "total"), [a, w], ["year", "month"])


@query("join_full_outer", """SELECT date, a.n AS a_rows, b.n AS b_rows, c.total FROM (SELECT date, COUNT(*) AS n FROM terminal_a GROUP BY date) a
FULL JOIN (SELECT date, COUNT(*) AS n FROM terminal_b GROUP BY date) b USING (date)
FULL JOIN (SELECT strftime(date, '%Y-%m') AS date, CAST(SUM(total) AS BIGINT) AS total FROM carrier_daily GROUP BY 1) c USING (date)""")
def join_full_outer(spark, d):
    def n(df, name):
        return df.groupBy("date").agg(F.count(F.lit(1)).alias(name))
    months = t.carrier_daily(spark, d).groupBy(fn.month_key("date").alias("date")).agg(F.sum("total").alias("total"))
    return j.merge_outer([n(t.terminal_a(spark, d), "a_rows"), n(t.terminal_b(spark, d), "b_rows"), months], ["date"])


@query("join_climatology", f"""WITH b AS (SELECT max(date) AS hi FROM carrier_daily),
s AS (SELECT CAST(unnest(generate_series(date_trunc('month', hi) + INTERVAL 1 MONTH, date_trunc('month', hi) + INTERVAL 72 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month_start FROM b),
k AS (SELECT month(date) AS month, {', '.join(f'ROUND(AVG({c}), 4) AS {c}' for c in W6)} FROM weather GROUP BY 1)
SELECT s.month_start, CAST(year(s.month_start) AS INT) AS year, CAST(month(s.month_start) AS INT) AS month, {', '.join('k.' + c for c in W6)}
FROM s LEFT JOIN k ON k.month = month(s.month_start)""")
def join_climatology(spark, d):
    last = t.carrier_daily(spark, d).agg(F.trunc(F.max("date"), "month").alias("d"))
    spine = spines.month_spine(spark, last.select(F.add_months("d", 1)).scalar(), last.select(F.add_months("d", 72)).scalar())
    history = t.weather(spark, d).withColumn("month", F.month("date"))
    return rounded(attach_climatology(spine, history, W6), W6)


# --- aggregates --------------------------------------------------------------------------------------

@query("agg_sum_monthly", "SELECT * FROM carrier_monthly")
def agg_sum_monthly(spark, d):
    return carrier_monthly(spark, d)


@query("agg_weather_max", WEATHER_MONTH)
def agg_weather_max(spark, d):
    return r.weather_by_month(t.weather(spark, d))


@query("agg_monthly_summary", """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, COUNT(*) AS n, ROUND(AVG(lane), 4) AS avg_lane,
  ROUND(AVG(time), 4) AS avg_time, MAX(fac_b) AS sample_fac_b, MAX(fac_g) AS sample_fac_g, MAX(day_name) AS sample_day FROM traffic_history GROUP BY 1, 2""")
def agg_monthly_summary(spark, d):
    out = t.traffic_history(spark, d).groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lane").alias("avg_lane"), F.avg("time").alias("avg_time"),
        F.max("fac_b").alias("sample_fac_b"), F.max("fac_g").alias("sample_fac_g"), F.max("day_name").alias("sample_day"))
    return rounded(out, ["avg_lane", "avg_time"])


@query("agg_trycast_sum", """SELECT substring(date,1,4) AS year, substring(date,6,2) AS month,
  CAST(SUM(TRY_CAST(buses_count AS BIGINT)) AS BIGINT) AS buses, CAST(SUM(TRY_CAST(passengers_count AS BIGINT)) AS BIGINT) AS passengers
FROM terminal_b GROUP BY 1, 2""")
def agg_trycast_sum(spark, d):
    return r.text_months(t.terminal_b(spark, d), "date").groupBy("year", "month").agg(
        F.sum(fn.to_count("buses_count")).alias("buses"), F.sum(fn.to_count("passengers_count")).alias("passengers"))


@query("agg_hourly_facility", f"""SELECT x.facility, CAST(x.date AS TIMESTAMP) + to_hours(CAST(x.time // 100 AS BIGINT)) AS ts,
  {', '.join(f'CAST(coalesce(SUM(x.{v}),0) AS BIGINT) AS {v}' for v in V4)},
  CAST(coalesce(SUM(coalesce(auto,0)+coalesce(small_trucks,0)+coalesce(large_trucks,0)+coalesce(busses,0)),0) AS BIGINT) AS total_vehicles,
  {', '.join(f'ROUND(AVG(w.{c}), 4) AS {c}' for c in W6)},
  x.date, CAST(x.time // 100 AS INT) AS hour, CAST(year(x.date) AS INT) AS year, CAST(month(x.date) AS INT) AS month,
  CAST(isodow(x.date) - 1 AS INT) AS day_of_week, lpad(CAST(x.time // 100 AS VARCHAR), 2, '0') || ':00' AS time
FROM traffic x LEFT JOIN weather w ON x.date = w.date GROUP BY x.facility, x.date, x.time // 100""")
def agg_hourly_facility(spark, d):
    rows = t.traffic(spark, d).withColumns({"ts": fn.hour_start(fn.at_time("date", "time")), "total_vehicles": fn.row_total(V4)})
    rows = rows.join(j.measured_side(t.weather(spark, d)), "date", "left").drop("date", "time", "lane")
    return rounded(hourly_by_facility(rows, [*V4, "total_vehicles"], W6), W6)


PROFILE_SQL = """SELECT facility, CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
  CAST(hour(ts) AS INT) AS hour, AVG(total_vehicles) AS total_vehicles FROM traffic_hourly GROUP BY 1, 2, 3"""


def hour_profile(spark, d):
    rows = traffic_hourly(spark, d).select("facility", fn.day_type("ts").alias("day_type"), F.hour("ts").alias("hour"), "total_vehicles")
    return day_type_profile(rows)


@query("agg_hour_profile", f"SELECT facility, day_type, hour, ROUND(total_vehicles, 4) AS total_vehicles FROM ({PROFILE_SQL})")
def agg_hour_profile(spark, d):
    return rounded(hour_profile(spark, d), ["total_vehicles"])


@query("agg_week_month_year", " UNION ALL ".join(
    f"SELECT '{b}' AS bucket, facility, CAST(date_trunc('{b}', ts) AS DATE) AS start, ROUND(AVG(total_vehicles), 4) AS mean_value FROM history_hourly GROUP BY 2, 3"
    for b in ("week", "month", "year")))
def agg_week_month_year(spark, d):
    from forecastops.operators.compare import profile
    rows = history_hourly(spark, d)
    parts = []
    for b in ("week", "month", "year"):
        start = F.make_date("year", F.lit(1), F.lit(1)) if b == "year" else F.col(b)
        parts.append(profile(rows, b).select(F.lit(b).alias("bucket"), "facility", start.alias("start"), "mean_value"))
    return rounded(agg.union_all(parts), ["mean_value"])


@query("agg_std", """SELECT fac_g, ROUND(stddev_samp(total), 4) AS std_total, ROUND(avg(total), 4) AS avg_total, COUNT(total) AS n FROM traffic_history GROUP BY fac_g""")
def agg_std(spark, d):
    out = t.traffic_history(spark, d).groupBy("fac_g").agg(
        F.stddev_samp("total").alias("std_total"), F.avg("total").alias("avg_total"), F.count("total").alias("n"))
    return rounded(out, ["std_total", "avg_total"])


PROBS = {"q05": 0.05, "q25": 0.25, "q33": 1 / 3, "q67": 2 / 3, "q75": 0.75, "q95": 0.95}


@query("agg_quantile", "SELECT fac_g, " + ", ".join(
    f"ROUND(quantile_cont(CAST(CASE WHEN total > 0 THEN total END AS DOUBLE), {p!r}), 4) AS {n}" for n, p in PROBS.items())
    + " FROM traffic_history GROUP BY fac_g")
def agg_quantile(spark, d):
    rows = t.traffic_history(spark, d).filter(F.col("total") > 0)
    return rounded(exact_quantiles(rows, ["fac_g"], "total", PROBS), list(PROBS))


@query("agg_distinct_month_facility", "SELECT DISTINCT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month, fac_g FROM traffic_history")
def agg_distinct_month_facility(spark, d):
    return r.text_months(t.traffic_history(spark, d), "date").select("year", "month", "fac_g").distinct()


@query("agg_range_counts", """SELECT x.day_type, x.n, y.first, y.last, y.rows FROM
 (SELECT CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, COUNT(*) AS n FROM history_hourly GROUP BY 1) x,
 (SELECT CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, COUNT(*) AS rows FROM history_hourly) y""")
def agg_range_counts(spark, d):
    rows = history_hourly(spark, d).select(F.to_date("ts").alias("date"), fn.day_type("ts").alias("day_type"))
    one = agg.range_summary(rows, "date").select(F.struct("*").alias("s")).scalar()
    return agg.value_counts(rows, "day_type").withColumn("s", one).select("day_type", "n", "s.first", "s.last", "s.rows")


@query("agg_pivot_year", """SELECT fac_g AS facility, """ + ", ".join(
    f"CAST(SUM(CASE WHEN year(date) = {y} THEN total END) AS BIGINT) AS y{y}" for y in range(1995, 2002)) + " FROM traffic_history GROUP BY fac_g")
def agg_pivot_year(spark, d):
    rows = t.traffic_history(spark, d).select(F.col("fac_g").alias("facility"), F.year("date").alias("year"), "total")
    return agg.pivot_found(rows, ["facility"], "year", "total", "y")


@query("agg_unpivot_series", " UNION ALL ".join(f"SELECT year, month, '{c}' AS series, {c} AS value FROM carrier_monthly" for c in C6))
def agg_unpivot_series(spark, d):
    return agg.unpivot(carrier_monthly(spark, d), ["year", "month"], C6, "series", "value")


# --- sorts, limits, unions ---------------------------------------------------------------------------

@query("sort_report", "SELECT year, month, total, af FROM carrier_monthly ORDER BY year NULLS FIRST, month NULLS FIRST")
def sort_report(spark, d):
    return r.ordered(carrier_monthly(spark, d).select("year", "month", "total", "af"), ["year", "month"])


@query("limit_topn", "SELECT date, total FROM carrier_daily ORDER BY total DESC, date LIMIT 24")
def limit_topn(spark, d):
    return t.carrier_daily(spark, d).select("date", "total").orderBy(F.desc("total"), "date").limit(24)


@query("union_same", "SELECT *, 'a' AS terminal FROM terminal_a UNION ALL SELECT *, 'b' AS terminal FROM terminal_b")
def union_same(spark, d):
    return agg.union_all([t.terminal_a(spark, d).withColumn("terminal", F.lit("a")), t.terminal_b(spark, d).withColumn("terminal", F.lit("b"))])


@query("union_missing_cols", """SELECT start_date, af, total, NULL::BIGINT AS bus_total FROM passenger_weekly
UNION ALL SELECT start_date, af, NULL::BIGINT AS total, bus_total FROM bus_weekly""")
def union_missing_cols(spark, d):
    return agg.union_all([t.passenger_weekly(spark, d).select("start_date", "af", "total"),
                          t.bus_weekly(spark, d).select("start_date", "af", "bus_total")], fill_missing=True)
