"""Sources, sinks, spines, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecastops import functions as fn
from forecastops.catalog.registry import query
from forecastops.catalog.tables import carrier_monthly, rounded, traffic_hourly
from forecastops.operators.aggregates import sum_by
from forecastops.operators.joins import prefix_columns, measured_side
from forecastops.sources import readers, sinks, spines
from forecastops.sources import standins as t
from forecastops.session import scratch_path

C6, W6, V4 = t.CARRIERS, t.WEATHER, t.VEHICLES

TRAFFIC_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()), T.StructField("lane", T.IntegerType()), T.StructField("time", T.IntegerType()),
    T.StructField("facility", T.StringType()), *[T.StructField(v, T.LongType()) for v in V4]])


# --- sources and sinks -------------------------------------------------------------------------------

@query("src_csv_roundtrip", "SELECT * FROM traffic")
def src_csv_roundtrip(spark, d):
    path = sinks.write_table(t.traffic(spark, d), scratch_path(spark, "traffic-csv"), "csv")
    return readers.read_csv(spark, path, TRAFFIC_SCHEMA)


@query("src_csv_headerless", "SELECT date, lane, time, facility, auto, small_trucks, large_trucks, busses FROM traffic")
def src_csv_headerless(spark, d):
    rows = t.traffic(spark, d)
    paths = []
    for name, part in {"early": rows.filter(F.dayofmonth("date") <= 15), "late": rows.filter(F.dayofmonth("date") > 15)}.items():
        paths.append(scratch_path(spark, f"traffic-{name}"))
        part.write.option("header", False).csv(paths[-1])
    raw = readers.read_csv_headerless(spark, paths, rows.columns)
    return raw.select(F.col("date").try_cast("date").alias("date"), F.col("lane").try_cast("int").alias("lane"),
                      F.col("time").try_cast("int").alias("time"), "facility", *[fn.to_count(v).alias(v) for v in V4])


@query("src_csv_by_name", "SELECT * FROM traffic")
def src_csv_by_name(spark, d):
    """Two exports with other column orders, blanks in the header and one column besides, united by name."""
    rows, paths = t.traffic(spark, d), []
    for name, part, order in (("early", rows.filter(F.dayofmonth("date") <= 15), rows.columns[::-1]), ("late", rows.filter(F.dayofmonth("date") > 15), sorted(rows.columns))):
        part = part.withColumn("remark", F.lit("x,y")).select("remark", *order)
        paths.append(sinks.write_table(part.toDF(*[f" {c} " for c in part.columns]), scratch_path(spark, f"by-name-{name}"), "csv"))
    return readers.read_csv_by_name(spark, paths, TRAFFIC_SCHEMA)


# Rows whose lane is 3 lose their last cell on the way, rows whose lane is 5 get one more.
@query("src_csv_quarantine", """SELECT CASE WHEN lane = 3 THEN 'short' WHEN lane = 5 THEN 'long' ELSE 'good' END AS kind,
  CAST(CASE WHEN lane = 3 THEN 7 WHEN lane = 5 THEN 9 ELSE 8 END AS INT) AS n_cells, COUNT(*) AS n, CAST(SUM(CASE WHEN lane IN (3, 5) THEN NULL ELSE auto END) AS BIGINT) AS auto
FROM traffic GROUP BY 1, 2""")
def src_csv_quarantine(spark, d):
    rows = t.traffic(spark, d)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    line = F.when(F.col("lane") == 3, F.concat_ws(",", *cells[:-1])).when(F.col("lane") == 5, F.concat_ws(",", *cells, F.lit("extra"))).otherwise(F.concat_ws(",", *cells))
    path = scratch_path(spark, "traffic-bad")
    rows.select(line.alias("value")).write.text(path)
    good, bad = readers.read_csv_quarantine(spark, path, rows.columns)
    kept = good.groupBy(F.lit("good").alias("kind"), F.lit(len(rows.columns)).alias("n_cells")).agg(F.count(F.lit(1)).alias("n"), F.sum(fn.to_count("auto")).alias("auto"))
    held = bad.groupBy(F.when(F.col("n_cells") < len(rows.columns), "short").otherwise("long").alias("kind"), "n_cells").agg(
        F.count("file").alias("n"), F.lit(None).cast("bigint").alias("auto"))
    return kept.unionByName(held)


@query("scan_roles", " UNION ALL ".join(f"SELECT '{r}' AS role, COUNT(*) AS n FROM {r}" for r in t.ROLES))
def scan_roles(spark, d):
    counts = [role(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("role"), "n")
              for name, role in t.ROLES.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("src_clean_names", "SELECT date, af AS red_blue, ao AS x_y_group, nf AS line_one, total FROM carrier_daily")
def src_clean_names(spark, d):
    raw = t.carrier_daily(spark, d).select("date", "af", "ao", "nf", "total").toDF(
        " Date", "Red/Blue ", "X & Y Group", " Line  One ", "TOTAL")
    return readers.clean_names(readers.trim_names(raw))


@query("sink_partitioned", f"SELECT year, month, {', '.join(C6)}, total FROM carrier_monthly")
def sink_partitioned(spark, d):
    path = sinks.write_table(carrier_monthly(spark, d), scratch_path(spark, "monthly"), partition_by=["year"])
    return readers.read_table(spark, path)


# The year 1996 is written again with other totals: only its partition changes.
@query("sink_replaced", "SELECT year, month, CASE WHEN year = 1996 THEN total + 1 ELSE total END AS total FROM carrier_monthly")
def sink_replaced(spark, d):
    rows = carrier_monthly(spark, d).select("year", "month", "total")
    path = sinks.write_table(rows, scratch_path(spark, "replaced"), partition_by=["year"])
    sinks.replace_partitions(rows.filter(F.col("year") == 1996).withColumn("total", F.col("total") + 1), path, ["year"])
    return readers.read_table(spark, path)


@query("spine_monthly", """WITH b AS (SELECT min(date) AS lo, max(date) AS hi FROM carrier_daily),
s AS (SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM b)
SELECT s.month_start, CAST(year(s.month_start) AS INT) AS year, CAST(month(s.month_start) AS INT) AS month, m.total
FROM s LEFT JOIN carrier_monthly m ON m.year = year(s.month_start) AND m.month = month(s.month_start)""")
def spine_monthly(spark, d):
    days = t.carrier_daily(spark, d)
    spine = spines.month_spine(spark, days.agg(F.min("date")).scalar(), days.agg(F.max("date")).scalar())
    return spine.join(carrier_monthly(spark, d).select("year", "month", "total"), ["year", "month"], "left").select(
        "month_start", "year", "month", "total")


@query("spine_hourly", """WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM traffic_hourly),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),
h AS (SELECT ts, CAST(SUM(total_vehicles) AS BIGINT) AS total_vehicles FROM traffic_hourly GROUP BY ts)
SELECT s.ts, h.total_vehicles FROM s LEFT JOIN h ON s.ts = h.ts""")
def spine_hourly(spark, d):
    hours = traffic_hourly(spark, d)
    spine = spines.hour_spine(spark, hours.agg(F.min("ts")).scalar(), hours.agg(F.max("ts")).scalar())
    return spine.join(sum_by(hours, ["ts"], ["total_vehicles"]), "ts", "left")


@query("grid_future", """SELECT CAST(y.y AS INT) AS year, CAST(m.m AS INT) AS month, h.time, f.fac_g AS facility
FROM (SELECT unnest(range(2002, 2005)) AS y) y CROSS JOIN (SELECT unnest(range(1, 13)) AS m) m
CROSS JOIN (SELECT DISTINCT time FROM traffic_history) h CROSS JOIN (SELECT DISTINCT fac_g FROM traffic_history) f""")
def grid_future(spark, d):
    rows = t.traffic_history(spark, d).select("time", F.col("fac_g").alias("facility"))
    return spines.future_grid(rows, (2002, 2004))


# --- projections -------------------------------------------------------------------------------------

@query("proj_alias", "SELECT date AS trip_date, lane AS lane_no, total AS vehicles, fac_g AS facility FROM traffic_history")
def proj_alias(spark, d):
    return t.traffic_history(spark, d).select(F.col("date").alias("trip_date"), F.col("lane").alias("lane_no"),
                                              F.col("total").alias("vehicles"), F.col("fac_g").alias("facility"))


@query("proj_star_prefixed", f"""SELECT x.*, {', '.join(f'w.{c} AS w_{c}' for c in W6)}, w.tmax AS w_tmax_again
FROM traffic x LEFT JOIN weather w ON x.date = w.date""")
def proj_star_prefixed(spark, d):
    side = prefix_columns(t.weather(spark, d).withColumn("tmax_again", F.col("tmax")), "w_", keep=("date",))
    return t.traffic(spark, d).join(measured_side(side), "date", "left").select("*")


@query("proj_quoted_names", """SELECT year, month, af AS red_blue_total, ao AS x_y_group_total, nf AS line_one_total FROM carrier_monthly""")
def proj_quoted_names(spark, d):
    wide = t.carrier_daily(spark, d).select("date", "af", "ao", "nf").toDF("Date", "Red/Blue", "X & Y Group", "Line One LD.")
    return wide.groupBy(F.year("`Date`").alias("year"), F.month("`Date`").alias("month")).agg(
        F.sum("`Red/Blue`").alias("red_blue_total"), F.sum("`X & Y Group`").alias("x_y_group_total"),
        F.sum("`Line One LD.`").alias("line_one_total"))


@query("proj_computed", """SELECT date, coalesce(af,0)+coalesce(ao,0)+coalesce(nf,0)+coalesce(no,0)+coalesce(rf,0)+coalesce(ro,0) AS total_known,
  af+nf+rf AS total_strict, CASE WHEN dayofweek(date) IN (0,6) THEN 1 ELSE 0 END AS weekend_flag,
  ROUND(CASE WHEN af <> 0 THEN (ro-af)*100.0/af END, 4) AS change_pct FROM carrier_daily""")
def proj_computed(spark, d):
    out = t.carrier_daily(spark, d).select(
        "date", fn.row_total(C6).alias("total_known"), fn.row_total_strict(["af", "nf", "rf"]).alias("total_strict"),
        fn.is_weekend("date").alias("weekend_flag"), fn.percent_change("af", "ro").alias("change_pct"))
    return rounded(out, ["change_pct"])


@query("proj_rename_drop", "SELECT date AS trip_date, lane, time, total AS avg_base, class_1, class_9, fac_b, fac_g FROM traffic_history")
def proj_rename_drop(spark, d):
    return t.traffic_history(spark, d).withColumnsRenamed({"date": "trip_date", "total": "avg_base"}).drop("buses", "day_name")


# --- filters -----------------------------------------------------------------------------------------

@query("filter_year_split", """SELECT CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'holdout' END AS split,
  CAST(year(o_orderdate) AS INT) AS year, COUNT(*) AS n FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY 1, 2""")
def filter_year_split(spark, d):
    orders = readers.read_table(spark, f"{d}/orders.parquet").select("o_orderdate")
    parts = {"train": fn.year_range("o_orderdate", 1, 1999), "holdout": fn.year_range("o_orderdate", 2000, 2000)}
    counted = [orders.filter(cond).groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
               .select(F.lit(name).alias("split"), "year", "n") for name, cond in parts.items()]
    return counted[0].unionByName(counted[1])


@query("filter_trycast_notnull", "SELECT date, route, CAST(buses_count AS BIGINT) AS buses FROM terminal_a WHERE TRY_CAST(buses_count AS BIGINT) IS NOT NULL")
def filter_trycast_notnull(spark, d):
    rows = t.terminal_a(spark, d).select("date", "route", fn.to_count("buses_count").alias("buses"))
    return rows.filter(F.col("buses").isNotNull())


@query("filter_dropna", f"SELECT date, {', '.join(W6)} FROM weather WHERE awnd IS NOT NULL AND snwd IS NOT NULL")
def filter_dropna(spark, d):
    return t.weather(spark, d).dropna(subset=["awnd", "snwd"])


@query("filter_membership", """SELECT date, lane, time, total FROM traffic_history
WHERE isodow(date) - 1 IN (5, 6) AND month(date) IN (6, 7, 8)""")
def filter_membership(spark, d):
    rows = t.traffic_history(spark, d).select("date", "lane", "time", "total")
    return rows.filter(F.weekday("date").isin(5, 6) & F.month("date").isin(6, 7, 8))


@query("filter_group_eq", "SELECT date, time, total FROM traffic_history WHERE fac_g = '1-URGENT' AND day_name = 'Monday'")
def filter_group_eq(spark, d):
    rows = t.traffic_history(spark, d)
    return rows.filter((F.col("fac_g") == "1-URGENT") & (F.col("day_name") == "Monday")).select("date", "time", "total")


# --- scalar functions --------------------------------------------------------------------------------

@query("fn_calendar", """SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d,
  CAST(hour(ts) AS INT) AS h, CAST(isodow(ts) - 1 AS INT) AS dow, CAST(date_trunc('month', ts) AS DATE) AS month_start,
  CAST(date_trunc('week', ts) AS DATE) AS week_start, make_date(year(ts), month(ts), 1) AS built FROM events""")
def fn_calendar(spark, d):
    return readers.read_table(spark, f"{d}/events.parquet").select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"),
        fn.weekday_monday0("ts").alias("dow"), fn.month_bucket("ts").alias("month_start"), fn.week_bucket("ts").alias("week_start"),
        fn.month_start(F.year("ts"), F.month("ts")).alias("built"))


@query("fn_date_text", """SELECT date, strftime(date, '%Y-%m-%d') AS iso, strftime(date, '%Y') AS y, strftime(date, '%m') AS m,
  strftime(date, '%Y-%m') AS ym, CAST(date_trunc('month', date) AS DATE) AS parsed FROM carrier_daily""")
def fn_date_text(spark, d):
    return t.carrier_daily(spark, d).select(
        "date", fn.iso_text("date").alias("iso"), fn.year_text("date").alias("y"), fn.month_text("date").alias("m"),
        F.date_format("date", "yyyy-MM").alias("ym"), fn.month_start_of_text(fn.month_key("date")).alias("parsed"))


@query("fn_trycast", """SELECT date, route, TRY_CAST(buses_count AS BIGINT) AS buses, TRY_CAST(passengers_count AS BIGINT) AS passengers,
  TRY_CAST(passengers_count AS DOUBLE) AS passengers_f, TRY_CAST(date || '-01' AS DATE) AS day, TRY_CAST(route AS DATE) AS no_day FROM terminal_b""")
def fn_trycast(spark, d):
    return t.terminal_b(spark, d).select(
        "date", "route", fn.to_count("buses_count").alias("buses"), fn.to_count("passengers_count").alias("passengers"),
        fn.to_number("passengers_count").alias("passengers_f"),
        F.concat("date", F.lit("-01")).try_cast("date").alias("day"), F.col("route").try_cast("date").alias("no_day"))


# The raw value runs past the end of the day on purpose.
@query("fn_hhmm", """WITH r AS (SELECT event_id, CAST(ts AS DATE) AS date, CAST(event_id % 2600 AS INT) AS hhmm, ts FROM events)
SELECT event_id, substring(lpad(CAST(hhmm AS VARCHAR), 4, '0'), 1, 2) || ':' || substring(lpad(CAST(hhmm AS VARCHAR), 4, '0'), 3) AS txt,
  CASE WHEN hhmm < 2400 AND hhmm % 100 < 60 THEN CAST(hhmm // 100 AS INT) END AS h,
  CASE WHEN hhmm < 2400 AND hhmm % 100 < 60 THEN CAST(date AS TIMESTAMP) + to_minutes(CAST(hhmm // 100 * 60 + hhmm % 100 AS BIGINT)) END AS at,
  strftime(ts, '%H:%M') AS clock FROM r""")
def fn_hhmm(spark, d):
    raw = readers.read_table(spark, f"{d}/events.parquet").select(
        "event_id", F.to_date("ts").alias("date"), (F.col("event_id") % 2600).cast("int").alias("hhmm"), "ts")
    return raw.select("event_id", fn.hhmm_text("hhmm").alias("txt"), fn.hhmm_hour("hhmm").alias("h"),
                      fn.at_time("date", "hhmm").alias("at"), fn.time_text("ts").alias("clock"))


@query("fn_day_type", """SELECT date, CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, total FROM carrier_daily""")
def fn_day_type(spark, d):
    return t.carrier_daily(spark, d).select("date", fn.day_type("date").alias("day_type"), fn.is_weekend("date").alias("is_weekend"), "total")


@query("fn_math", """SELECT event_id, ROUND(ln(1 + value), 6) AS log_up, ROUND(exp(ln(1 + value)) - 1, 6) AS log_back, ROUND(sqrt(value), 6) AS root,
  ROUND(abs(value - 100), 6) AS dist, ROUND(sin(value), 6) AS wave, CAST(round_even(value, 0) AS BIGINT) AS whole,
  CAST(round_even(event_id / 2.0, 0) AS BIGINT) AS half, ROUND(least(greatest(value, 5.0), 50.0), 6) AS held FROM events""")
def fn_math(spark, d):
    v = F.col("value")
    return readers.read_table(spark, f"{d}/events.parquet").select(
        "event_id", F.round(F.log1p(v), 6).alias("log_up"), F.round(F.expm1(F.log1p(v)), 6).alias("log_back"),
        F.round(F.sqrt(v), 6).alias("root"), F.round(F.abs(v - 100), 6).alias("dist"), F.round(F.sin(v), 6).alias("wave"),
        F.rint(v).cast("bigint").alias("whole"), fn.half_even(F.col("event_id") / 2.0).cast("bigint").alias("half"),
        F.round(fn.clip(v, 5.0, 50.0), 6).alias("held"))
