"""Windows, imputation, quantile filters, splits and tiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from forecastops.catalog.registry import query
from forecastops.catalog.relational import PROFILE_SQL, hour_profile
from forecastops.catalog.tables import carrier_monthly, rounded, traffic_hourly
from forecastops.operators import ordered as o
from forecastops.operators import prepare as p
from forecastops.operators import quantiles as q
from forecastops.operators import segments as seg
from forecastops.operators import splits
from forecastops.plans import reports as r
from forecastops.sources import readers
from forecastops.sources import standins as t

C6, W6, V4 = t.CARRIERS, t.WEATHER, t.VEHICLES


@query("win_first_of_month", f"""SELECT year, month, {', '.join(W6)} FROM (SELECT strftime(date, '%Y') AS year, strftime(date, '%m') AS month, {', '.join(W6)},
  ROW_NUMBER() OVER (PARTITION BY strftime(date, '%Y'), strftime(date, '%m') ORDER BY date) AS rn FROM weather) WHERE rn = 1""")
def win_first_of_month(spark, d):
    rows = r.text_months(t.weather(spark, d), "date")
    return o.first_per_group(rows, ["year", "month"], ["date"]).select("year", "month", *W6)


LAG_SQL = """SELECT facility, ts, total_vehicles,
  lag(total_vehicles, 1) OVER w AS lag_1h, lag(total_vehicles, 24) OVER w AS lag_24h,
  CASE WHEN COUNT(total_vehicles) OVER (PARTITION BY facility ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
    THEN ROUND(AVG(total_vehicles) OVER (PARTITION BY facility ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) END AS rolling_mean_24h
FROM traffic_hourly WINDOW w AS (PARTITION BY facility ORDER BY ts)"""


def _lagged(spark, d, trim):
    # The day of the timestamp slices a facility into at most 24 rows.
    rows = o.lag_features(traffic_hourly(spark, d), ["facility"], "ts", "total_vehicles", slice_by=F.to_date("ts"), trim_warmup=trim)
    return rounded(rows, ["rolling_mean_24h"])


@query("win_lags", f"SELECT * FROM ({LAG_SQL}) WHERE lag_1h IS NOT NULL AND lag_24h IS NOT NULL AND rolling_mean_24h IS NOT NULL")
def win_lags(spark, d):
    return _lagged(spark, d, True)


@query("win_rolling_mean", f"SELECT facility, ts, rolling_mean_24h FROM ({LAG_SQL})")
def win_rolling_mean(spark, d):
    return _lagged(spark, d, False).select("facility", "ts", "rolling_mean_24h")


MEDIAN_COLS, MEAN_COLS = ["awnd", "prcp", "snow", "snwd"], ["tmax", "tmin"]


@query("impute_median_mean", f"""WITH b AS (SELECT date, month(date) AS m, {', '.join(f'NULLIF({c}, 0) AS {c}' for c in W6)} FROM weather),
g AS (SELECT m, {', '.join(f'median({c}) AS {c}' for c in MEDIAN_COLS)}, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLS)} FROM b GROUP BY m),
f AS (SELECT b.date, {', '.join(f'coalesce(b.{c}, g.{c}) AS {c}' for c in W6)} FROM b LEFT JOIN g ON b.m = g.m),
a AS (SELECT {', '.join(f'median({c}) AS {c}' for c in MEDIAN_COLS)}, {', '.join(f'avg({c}) AS {c}' for c in MEAN_COLS)} FROM f)
SELECT f.date, {', '.join(f'ROUND(coalesce(f.{c}, a.{c}), 4) AS {c}' for c in W6)} FROM f, a""")
def impute_median_mean(spark, d):
    rows = t.weather(spark, d).withColumn("month", F.month("date"))
    rows = p.impute_seasonal(rows, MEDIAN_COLS, stat="median")
    return rounded(p.impute_seasonal(rows, MEAN_COLS, stat="mean").drop("month"), W6)


def _line(c):
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_lv IS NULL THEN NULL WHEN {c}_rv IS NULL THEN {c}_lv
  ELSE {c}_lv + ({c}_rv - {c}_lv) * (rn - {c}_lp) / ({c}_rp - {c}_lp) END"""


def _ends(c):
    up, down = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    known = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    return ", ".join([
        f"last_value({c} IGNORE NULLS) OVER (ORDER BY rn {up}) AS {c}_lv", f"first_value({c} IGNORE NULLS) OVER (ORDER BY rn {down}) AS {c}_rv",
        f"last_value({known} IGNORE NULLS) OVER (ORDER BY rn {up}) AS {c}_lp", f"first_value({known} IGNORE NULLS) OVER (ORDER BY rn {down}) AS {c}_rp"])


@query("impute_linear", f"""WITH n AS (SELECT date, awnd, snwd, prcp, ROW_NUMBER() OVER (ORDER BY date) AS rn FROM weather),
e AS (SELECT *, {_ends('awnd')}, {_ends('snwd')} FROM n)
SELECT date, prcp, ROUND({_line('awnd')}, 4) AS awnd, ROUND({_line('snwd')}, 4) AS snwd FROM e""")
def impute_linear(spark, d):
    rows = t.weather(spark, d).select("date", "awnd", "snwd", "prcp")
    return rounded(o.interpolate_linear(rows, ["date"], ["awnd", "snwd"], slice_by=F.year("date")), ["awnd", "snwd"])


@query("filter_iqr", """WITH f AS (SELECT facility, quantile_cont(CAST(total_vehicles AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(total_vehicles AS DOUBLE), 0.75) AS q3
  FROM traffic_hourly GROUP BY facility)
SELECT h.facility, h.ts, h.total_vehicles FROM traffic_hourly h JOIN f ON h.facility = f.facility
WHERE h.total_vehicles BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def filter_iqr(spark, d):
    return q.iqr_filter(traffic_hourly(spark, d), ["facility"], "total_vehicles")


# Means are rounded before tiers and ranks are taken, so that both engines compare equal numbers.
ROUNDED_PROFILE = f"SELECT facility, day_type, hour, ROUND(total_vehicles, 4) AS total_vehicles FROM ({PROFILE_SQL})"
TIER_SQL = f"""WITH pr AS ({ROUNDED_PROFILE}),
cut AS (SELECT facility, day_type, ROUND(quantile_cont(total_vehicles, 1/3.0), 6) AS c1, ROUND(quantile_cont(total_vehicles, 2/3.0), 6) AS c2 FROM pr
  GROUP BY 1, 2 HAVING COUNT(DISTINCT total_vehicles) >= 3),
tier AS (SELECT pr.*, CASE WHEN total_vehicles <= c1 THEN 'Free' WHEN total_vehicles <= c2 THEN 'Moderate' ELSE 'Peak' END AS traffic_level
  FROM pr JOIN cut USING (facility, day_type))"""


def tiers(spark, d):
    return seg.tercile_tiers(rounded(hour_profile(spark, d), ["total_vehicles"]), ["facility", "day_type"], "total_vehicles")


@query("tier_quantile", f"{TIER_SQL} SELECT * FROM tier")
def tier_quantile(spark, d):
    return tiers(spark, d)


@query("topk_busiest_hours", f"""{TIER_SQL}
SELECT facility, day_type, hour, total_vehicles, traffic_level, CAST(rn AS INT) AS rank FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY facility, day_type ORDER BY total_vehicles DESC, hour) AS rn FROM tier) WHERE rn <= 3""")
def topk_busiest_hours(spark, d):
    return o.top_k(tiers(spark, d), ["facility", "day_type"], [F.desc("total_vehicles"), "hour"], 3, rank="rank")


@query("split_chrono", """SELECT facility, ts, CASE WHEN rn <= n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'train' ELSE 'valid' END AS split FROM
 (SELECT facility, ts, ROW_NUMBER() OVER (PARTITION BY facility ORDER BY ts) AS rn, COUNT(*) OVER (PARTITION BY facility) AS n FROM traffic_hourly)""")
def split_chrono(spark, d):
    return splits.split_chronological(traffic_hourly(spark, d).select("facility", "ts"), ["facility"], "ts", F.to_date("ts"))


HASH = "('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT"


@query("split_random", f"""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY {HASH}, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn > n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM h""")
def split_random(spark, d):
    orders = readers.read_table(spark, f"{d}/orders.parquet").select("o_orderkey")
    return splits.split_random(orders, ["o_orderkey"])


@query("split_stratified", f"""WITH l AS (SELECT o_orderkey, o_orderstatus AS label, {HASH} AS h FROM orders),
c AS (SELECT label, COUNT(*) AS n FROM l GROUP BY label),
s AS (SELECT label, n, SUM(n) OVER () AS n_all, SUM(n) OVER () - ceil(SUM(n) OVER () * 0.2) AS n_train FROM c),
z AS (SELECT label, n * n_train / n_all AS share, n_train FROM s),
u AS (SELECT label, CAST(floor(share) AS BIGINT) + CASE WHEN ROW_NUMBER() OVER (ORDER BY share - floor(share) DESC, label) <= n_train - SUM(floor(share)) OVER () THEN 1 ELSE 0 END AS target FROM z)
SELECT o_orderkey, label, CASE WHEN rn <= target THEN 'train' ELSE 'test' END AS split FROM
 (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY label ORDER BY h, o_orderkey) AS rn FROM l) JOIN u USING (label)""")
def split_stratified(spark, d):
    orders = readers.read_table(spark, f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return splits.split_stratified(orders, "label", ["o_orderkey"])


@query("cv_fold_bounds", """WITH n AS (SELECT facility, COUNT(*) AS n FROM traffic_hourly GROUP BY facility),
f AS (SELECT facility, n, n // 4 AS size, unnest(range(1, 4)) AS fold FROM n)
SELECT facility, CAST(fold AS INT) AS fold, n, CAST(0 AS BIGINT) AS train_start, n - (4 - fold) * size AS train_end,
  n - (4 - fold) * size AS test_start, n - (4 - fold) * size + size AS test_end FROM f""")
def cv_fold_bounds(spark, d):
    return splits.expanding_folds(traffic_hourly(spark, d), ["facility"], 3)


@query("label_high_traffic", f"""WITH s AS (SELECT year, month, {' + '.join(f'coalesce({c}, 0)' for c in C6)} AS total_passengers FROM carrier_monthly)
SELECT year, month, total_passengers, CASE WHEN total_passengers >= (SELECT quantile_cont(CAST(total_passengers AS DOUBLE), 0.75) FROM s) THEN 1 ELSE 0 END AS high_traffic FROM s""")
def label_high_traffic(spark, d):
    return seg.high_traffic(carrier_monthly(spark, d), C6).select("year", "month", "total_passengers", "high_traffic")


@query("seg_standardise", "SELECT year, month, " + ", ".join(
    f"ROUND(({c} - AVG({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}_z" for c in C6) + " FROM carrier_monthly")
def seg_standardise(spark, d):
    out = seg.standardise(carrier_monthly(spark, d).drop("total"), C6)
    return rounded(out.drop(*C6), [f"{c}_z" for c in C6])


@query("etl_reshape_hourly", """SELECT date, substring(lpad(CAST(time AS VARCHAR), 4, '0'), 1, 2) || ':' || substring(lpad(CAST(time AS VARCHAR), 4, '0'), 3) AS time,
  facility, CAST(coalesce(auto,0)+coalesce(small_trucks,0)+coalesce(large_trucks,0)+coalesce(busses,0) AS DOUBLE) AS total_vehicles,
  CAST(time // 100 AS INT) AS hour, CAST(isodow(date) - 1 AS INT) AS dayofweek, CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM traffic""")
def etl_reshape_hourly(spark, d):
    raw = t.traffic(spark, d)
    return p.reshape_hourly(raw.select([F.col(c).cast("string").alias(c) for c in raw.columns]), V4)


@query("feat_onehot", """SELECT date, time, total, CASE WHEN fac_g = '1-URGENT' THEN 1 ELSE 0 END AS facility_1, CASE WHEN fac_g = '2-HIGH' THEN 1 ELSE 0 END AS facility_2,
  CASE WHEN fac_g = '3-MEDIUM' THEN 1 ELSE 0 END AS facility_3, CASE WHEN fac_g = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS facility_4,
  CASE WHEN fac_g = '5-LOW' THEN 1 ELSE 0 END AS facility_5 FROM traffic_history""")
def feat_onehot(spark, d):
    levels = {"1-URGENT": "facility_1", "2-HIGH": "facility_2", "3-MEDIUM": "facility_3", "4-NOT SPECIFIED": "facility_4", "5-LOW": "facility_5"}
    return p.one_hot(t.traffic_history(spark, d).select("date", "time", "total", "fac_g"), "fac_g", levels).drop("fac_g")


@query("feat_onehot_learned", """WITH c AS (SELECT fac_g AS level, COUNT(*) AS n FROM traffic_history GROUP BY fac_g)
SELECT level, CAST(row_number() OVER (ORDER BY n DESC, level) - 1 AS INT) AS place, (SELECT CAST(COUNT(*) + 1 AS INT) FROM c) AS width, n FROM c""")
def feat_onehot_learned(spark, d):
    """Place of every row's level in a vector whose levels come from the data."""
    rows = t.traffic_history(spark, d).select(F.col("fac_g").alias("level"))
    marks = vector_to_array("v")
    marked = p.learn_levels(rows, "level").vector(rows, "v").select("level", (F.array_position(marks, F.lit(1.0)) - 1).cast("int").alias("place"), F.size(marks).alias("width"))
    return marked.groupBy("level", "place", "width").agg(F.count(F.lit(1)).alias("n"))


def normal_sql(key):
    """Box-Muller draw of a text key, for the comparison SQL."""
    def u(tail):
        return f"((('0x' || substr(md5({key} || '|{tail}'), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u('a')})) * cos(2.0 * pi() * {u('b')}))"


@query("fc_weather_jitter", f"""WITH b AS (SELECT max(date) AS hi FROM carrier_daily),
s AS (SELECT CAST(unnest(generate_series(date_trunc('month', hi) + INTERVAL 1 MONTH, date_trunc('month', hi) + INTERVAL 72 MONTH, INTERVAL 1 MONTH)) AS DATE) AS month_start FROM b),
k AS (SELECT month(date) AS m, {', '.join(f'AVG({c}) AS {c}' for c in W6)} FROM weather GROUP BY 1),
z AS (SELECT {', '.join(f'stddev_samp({c}) AS {c}' for c in W6)} FROM weather)
SELECT s.month_start, {', '.join(f"ROUND(greatest(k.{c} + {normal_sql(f'''('42|{c}|' || CAST(s.month_start AS VARCHAR))''')} * z.{c} * 0.05, 0.0), 4) AS {c}" for c in W6)}
FROM s JOIN k ON k.m = month(s.month_start), z""")
def fc_weather_jitter(spark, d):
    from forecastops.sources import spines
    last = t.carrier_daily(spark, d).agg(F.trunc(F.max("date"), "month").alias("d"))
    spine = spines.month_spine(spark, last.select(F.add_months("d", 1)).scalar(), last.select(F.add_months("d", 72)).scalar())
    history = t.weather(spark, d).withColumn("month", F.month("date"))
    future = p.attach_climatology(spine, history, W6)
    return rounded(p.jitter(future, history, W6, F.col("month_start")), W6).select("month_start", *W6)
