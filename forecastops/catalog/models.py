"""Models and evaluation.

Fitted values cannot be stated in SQL. Such queries return counts that the fit must satisfy (rows of the
grid, values outside their bounds, residuals not orthogonal to a feature), and SQL states those counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastops import functions as fn
from forecastops.catalog.ordered import normal_sql
from forecastops.catalog.registry import query
from forecastops.catalog.tables import carrier_monthly, rounded, traffic_hourly
from forecastops.operators import evaluate as ev
from forecastops.operators import forecast as fc
from forecastops.operators import segments as seg
from forecastops.operators import splits
from forecastops.plans import pipelines as pl
from forecastops.plans import reports as r
from forecastops.sources import standins as t

C6, W6 = t.CARRIERS, t.WEATHER
COUNTS = ["a_passengers", "b_passengers", "d_passengers"]


# --- linear regression -------------------------------------------------------------------------------

@query("lr_single_feature", "SELECT ROUND(regr_slope(total, class_1), 4) AS slope, ROUND(regr_intercept(total, class_1), 4) AS intercept FROM traffic_history")
def lr_single_feature(spark, d):
    fit = fc.fit_linear(t.traffic_history(spark, d).select("class_1", "total"), ["class_1"], "total")
    return spark.createDataFrame([(round(fit.coefficients[0], 4), round(fit.intercept, 4))], "slope double, intercept double")


def passenger_hours(spark, d):
    rows = r.facility_hours_with_counts(t.traffic_history(spark, d), t.terminal_a(spark, d), t.terminal_b(spark, d),
                                        t.passenger_weekly(spark, d), t.weather(spark, d))
    rows = rows.select(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
                       F.col("fac_g").alias("facility"), "time", *COUNTS, *W6)
    return pl.prepare_passenger_hours(rows, COUNTS, W6)


def passenger_fit(spark, d):
    return pl.passenger_hour_forecast(passenger_hours(spark, d), W6, 2000, (2002, 2004))


@query("lr_normal_equations", "SELECT 1 + 6 + COUNT(DISTINCT fac_g) AS features, CAST(0 AS BIGINT) AS violations FROM traffic_history")
def lr_normal_equations(spark, d):
    """Residuals of a least-squares fit are orthogonal to every feature."""
    out = passenger_fit(spark, d)
    rows = out.model.score(out.train.dropna(subset=W6), "p").withColumn("res", F.col("total_passengers") - F.col("p"))
    inputs = {f"f{i}": F.col(c).cast("double") for i, c in enumerate(["time", *W6])} | {"one": F.lit(1.0)}
    sums = rows.groupBy("facility").agg(*[F.sum(F.col("res") * x).alias(n) for n, x in inputs.items()],
                                        *[F.sum(F.abs(F.col("total_passengers") * x)).alias(f"{n}_size") for n, x in inputs.items()])
    off = lambda total, size: (F.abs(total) > 1e-6 * size).cast("bigint")
    numeric = [n for n in inputs if n != "one"]
    return sums.agg((F.lit(len(numeric)) + F.count(F.lit(1))).cast("bigint").alias("features"),
                    (sum([off(F.sum(n), F.sum(f"{n}_size")) for n in numeric], F.lit(0)) + F.sum(off(F.col("one"), F.col("one_size")))).cast("bigint").alias("violations"))


# Within each level, centred: the slope of one feature and what is left of each level's mean.
@query("lr_category_effects", """WITH m AS (SELECT fac_g, AVG(total) AS my, AVG(class_1) AS mx FROM traffic_history GROUP BY fac_g),
b AS (SELECT SUM((t.class_1 - m.mx) * (t.total - m.my)) / SUM((t.class_1 - m.mx) * (t.class_1 - m.mx)) AS slope FROM traffic_history t JOIN m ON m.fac_g = t.fac_g),
e AS (SELECT fac_g, my - slope * mx AS effect FROM m, b)
SELECT 'numeric' AS part, 'class_1' AS feature, ROUND(slope, 4) AS coefficient FROM b
UNION ALL SELECT 'level', 'fac_g_' || fac_g, ROUND(effect - (SELECT AVG(effect) FROM e), 4) FROM e""")
def lr_category_effects(spark, d):
    fit = fc.fit_linear(t.traffic_history(spark, d).select("class_1", "total", "fac_g"), ["class_1"], "total", "fac_g")
    return rounded(fit.table(spark), ["coefficient"])


@query("lr_coefficients")
def lr_coefficients(spark, d):
    return passenger_fit(spark, d).model.table(spark)


@query("lr_moments", """WITH s AS (SELECT var_pop(class_1) AS s11, var_pop(class_9) AS s22, covar_pop(class_1, class_9) AS s12, covar_pop(class_1, total) AS s1y,
  covar_pop(class_9, total) AS s2y, AVG(class_1) AS m1, AVG(class_9) AS m2, AVG(total) AS my FROM traffic_history),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT 'class_1' AS feature, ROUND(b1, 4) AS coefficient FROM b UNION ALL SELECT 'class_9', ROUND(b2, 4) FROM b
UNION ALL SELECT 'intercept', ROUND(my - b1 * m1 - b2 * m2, 4) FROM b""")
def lr_moments(spark, d):
    """Two coefficients from moments of the early and the late years, added up."""
    rows, features = t.traffic_history(spark, d).select("date", "class_1", "class_9", "total"), ["class_1", "class_9"]
    parts = [fc.moment_table(rows.filter(part), features, "total") for part in (F.year("date") < 1999, F.year("date") >= 1999)]
    return rounded(fc.solve_moments(fc.add_moments(parts), features), ["coefficient"])


@query("fc_hourly_lr", """SELECT (SELECT COUNT(DISTINCT time) FROM traffic_history) * (SELECT COUNT(DISTINCT fac_g) FROM traffic_history) * 36 AS n,
  CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS differing_between_years, (SELECT COUNT(DISTINCT fac_g) FROM traffic_history) AS means_kept""")
def fc_hourly_lr(spark, d):
    """``means_kept`` counts the facilities whose mean prediction over the training rows is the mean of the label."""
    out = passenger_fit(spark, d)
    rows = out.forecast
    means = out.model.score(out.train.dropna(subset=W6), "p").groupBy("facility").agg(F.avg("p").alias("p"), F.avg("total_passengers").alias("y"))
    kept = means.agg(F.sum((F.abs(F.col("p") - F.col("y")) <= 1e-6 * F.abs(F.col("y"))).cast("bigint")).alias("means_kept"))
    p = fn.nan_to_null("predicted_passengers")
    cells = rows.groupBy("month", "time", "facility").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p.isNull().cast("bigint")).alias("missing"), (F.max(p) - F.min(p)).alias("range"))
    return cells.agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"),
                     F.sum((F.col("range") > 1e-6).cast("bigint")).alias("differing_between_years")).withColumn("means_kept", kept.scalar())


# --- monthly series ----------------------------------------------------------------------------------

SMALL = fc.BoostParams(n_estimators=5, max_depth=3)


def learned(rows, by, actual, predicted):
    """Per group: whether the predictions of the training rows vary and beat the mean of the label."""
    y, p = F.col(actual).cast("double"), F.col(predicted)
    better = F.sum((y - p) * (y - p)) < F.var_pop(y) * F.count(y)
    return rows.groupBy(by).agg((better & (F.count_distinct(p) > 1)).alias("learned"))


def series_history(spark, d):
    rows = r.passengers_buses_weather(t.passenger_weekly(spark, d), t.bus_weekly(spark, d), t.weather(spark, d))
    rows = rows.select("year", "month", *[F.col(f"passenger_{c}").alias(c) for c in C6], *W6)
    return pl.prepare_series(rows, C6, W6)


@query("fc_series_gbt", """SELECT s.series, CAST(24 AS BIGINT) AS n_future, (SELECT COUNT(DISTINCT month(start_date)) FROM passenger_weekly WHERE year(start_date) = 2000) AS n_eval,
  CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS missing, true AS learned FROM (VALUES ('af'), ('ao'), ('nf'), ('no'), ('rf'), ('ro')) s(series)""")
def fc_series_gbt(spark, d):
    out = pl.series_forecast(series_history(spark, d), C6, W6, 2000, "2002-01-01", "2003-12-01", [SMALL])
    held = F.col("forecast") / 1.1
    outside = (held < F.col("low") - 1e-6) | (held > F.col("high") + 1e-6)
    ahead = out.forecast.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_future"), F.sum(outside.cast("bigint")).alias("outside"),
        F.sum(F.col("forecast").isNull().cast("bigint")).alias("missing"))
    back = out.actual_vs_predicted.groupBy("series").agg(F.count("predicted").alias("n_eval"))
    fitted = learned(out.fitted, "series", "actual", "predicted")
    return ahead.join(back, "series").join(fitted, "series").select("series", "n_future", "n_eval", "outside", "missing", "learned")


@query("fc_history_union", """WITH h AS (SELECT DISTINCT CAST(year(start_date) AS INT) AS year, month(start_date) AS month FROM passenger_weekly)
SELECT year, COUNT(*) AS n, COUNT(*) AS n_af, COUNT(*) AS n_tmax, CAST(6 AS BIGINT) AS series_learned FROM h GROUP BY year
UNION ALL SELECT CAST(y AS INT), CAST(12 AS BIGINT), CAST(12 AS BIGINT), CAST(12 AS BIGINT), CAST(6 AS BIGINT) FROM (SELECT unnest(range(2002, 2004)) AS y)""")
def fc_history_union(spark, d):
    out = pl.series_forecast(series_history(spark, d), C6, W6, 2000, "2002-01-01", "2003-12-01", [SMALL], mode="pooled")
    ok = learned(out.fitted, "series", "actual", "predicted").agg(F.sum(F.col("learned").cast("bigint")).alias("series_learned"))
    years = out.combined.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("af").alias("n_af"), F.count("tmax").alias("n_tmax"))
    return years.withColumn("series_learned", ok.scalar())


@query("fc_series_terminal_b", """SELECT s.series, CAST(24 AS BIGINT) AS n_future, (SELECT COUNT(DISTINCT month(date)) FROM carrier_daily WHERE year(date) = 2000) AS n_eval,
  CAST(5 AS BIGINT) AS folds, CAST(0 AS BIGINT) AS missing, true AS learned FROM (VALUES ('af'), ('ao'), ('nf'), ('no'), ('rf'), ('ro')) s(series)""")
def fc_series_terminal_b(spark, d):
    """The second terminal: series of report 1, one setting, five folds, one pooled model."""
    rows = r.carriers_with_terminal_and_weather(t.carrier_daily(spark, d), t.terminal_a(spark, d), t.weather(spark, d))
    history = pl.prepare_series(rows.select("year", "month", *C6, *W6), C6, W6)
    out = pl.series_forecast(history, C6, W6, 2000, "2002-01-01", "2003-12-01", pl.GRID_TERMINAL_B, pl.FOLDS_TERMINAL_B, mode="pooled")
    ahead = out.forecast.groupBy("series").agg(F.count(F.lit(1)).alias("n_future"), F.sum(F.col("forecast").isNull().cast("bigint")).alias("missing"))
    back = out.actual_vs_predicted.groupBy("series").agg(F.count("predicted").alias("n_eval"))
    folds = F.lit(len({fold for _, _, fold, _ in out.fold_scores})).cast("bigint").alias("folds")
    return ahead.join(back, "series").join(learned(out.fitted, "series", "actual", "predicted"), "series").select(
        "series", "n_future", "n_eval", folds, "missing", "learned")


@query("cv_grid_search", """WITH m AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT year(start_date), month(start_date) FROM passenger_weekly WHERE year(start_date) < 2000)),
f AS (SELECT unnest([1, 2, 3]) AS fold), g AS (SELECT unnest([2, 3]) AS max_depth), s AS (SELECT unnest(['af','ao','nf','no','rf','ro']) AS series)
SELECT series, CAST(max_depth AS INT) AS max_depth, CAST(fold AS INT) AS fold, n - (4 - fold) * (n // 4) AS n_train, n // 4 AS n_test,
  true AS scored, true AS chosen_is_lowest FROM m, f, g, s""")
def cv_grid_search(spark, d):
    """Every fold of every series and setting: its rows, and whether the setting chosen has the lowest mean error."""
    history = series_history(spark, d).filter(F.col("year") < 2000)
    grid = fc.param_grid(n_estimators=[5], max_depth=[2, 3])
    best, scores = pl.search_series(history, [*W6, "year", "month"], C6, grid, 3)
    mean = {(c, p): sum(e for s, q, _, e in scores if (s, q) == (c, p)) / 3 for c in C6 for p in grid}
    rows = [(c, p.max_depth, fold, e > 0 and e < float("inf"), mean[c, best[c]] == min(mean[c, q] for q in grid)) for c, p, fold, e in scores]
    table = spark.createDataFrame(rows, "series string, max_depth int, fold int, scored boolean, chosen_is_lowest boolean")
    bounds = splits.expanding_folds(history.select(F.lit(1).alias("all")), ["all"], 3).select(
        F.col("fold").cast("int").alias("fold"), F.col("train_end").cast("bigint").alias("n_train"), (F.col("test_end") - F.col("test_start")).cast("bigint").alias("n_test"))
    return table.join(F.broadcast(bounds), "fold").select("series", "max_depth", "fold", "n_train", "n_test", "scored", "chosen_is_lowest")


# Naive forecast: the same month one year before.
NAIVE_SQL = """naive AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS series, make_date(a.year, a.month, 1) AS month_start, CAST(a.{c} AS DOUBLE) AS actual, CAST(b.{c} AS DOUBLE) AS predicted
FROM carrier_monthly a LEFT JOIN carrier_monthly b ON b.year = a.year - 1 AND b.month = a.month""" for c in C6) + ")"


def naive(spark, d):
    long = carrier_monthly(spark, d).unpivot(["year", "month"], C6, "series", "value").select(
        "series", fn.month_start("year", "month").alias("month_start"), F.col("value").cast("double").alias("actual"))
    return ev.seasonal_naive(long, ["series"], "month_start", "actual")


@query("eval_metrics", f"""WITH {NAIVE_SQL}
SELECT series, ROUND(AVG(abs(actual - predicted)), 4) AS mae, ROUND(sqrt(AVG((actual - predicted) * (actual - predicted))), 4) AS rmse,
  ROUND(AVG(abs(CASE WHEN actual <> 0 THEN (actual - predicted) / actual END)) * 100, 4) AS mape
FROM naive WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY series""")
def eval_metrics(spark, d):
    return rounded(ev.forecast_metrics(naive(spark, d), ["series"]), ["mae", "rmse", "mape"])


@query("eval_actual_vs_pred", f"WITH {NAIVE_SQL} SELECT * FROM naive")
def eval_actual_vs_pred(spark, d):
    wide = carrier_monthly(spark, d).select(fn.month_start("year", "month").alias("month_start"), *C6)
    for c in C6:
        wide = ev.seasonal_naive(wide, [], "month_start", c, f"{c}_p")
    return ev.actual_vs_predicted(wide, ["month_start"], {c: (c, f"{c}_p") for c in C6})


ADJUST_KEY = "('42|' || n.series || '|' || CAST(n.month_start AS VARCHAR))"


@query("fc_season_adjust", f"""WITH {NAIVE_SQL},
bo AS (SELECT series, quantile_cont(CASE WHEN actual > 0 THEN actual END, 0.05) AS low, quantile_cont(actual, 0.95) AS high FROM naive GROUP BY series),
w AS (SELECT n.series, n.month_start, bo.low, bo.high, n.predicted * (1 + 0.05 * sin(2 * pi() * (year(month_start) * 12 + month(month_start) - 2000 * 12 - 1) / 12.0))
  * (1 + 0.05 * {normal_sql(ADJUST_KEY)}) AS raw FROM naive n JOIN bo ON bo.series = n.series WHERE n.predicted IS NOT NULL)
SELECT series, month_start, ROUND(least(greatest(raw, low), high) * 1.1, 3) AS forecast FROM w""")
def fc_season_adjust(spark, d):
    rows = naive(spark, d)
    bounds = fc.series_bounds(rows, value="actual")
    out = fc.season_adjust(rows.filter(F.col("predicted").isNotNull()).join(bounds, "series"), "predicted", "series",
                           "month_start", "2000-01-01")
    return rounded(out.select("series", "month_start", "forecast"), ["forecast"], 3)


# --- segments and classification ---------------------------------------------------------------------

@query("seg_kmeans_series", "SELECT COUNT(*) AS n, CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS unlabelled, CAST(0 AS BIGINT) AS nearer_elsewhere FROM carrier_monthly")
def seg_kmeans_series(spark, d):
    """Every month belongs to the cluster whose mean is nearest."""
    out = seg.cluster_series(carrier_monthly(spark, d).na.fill(0), C6)
    z = [f"{c}_z" for c in C6]
    means = [list(m) for m in out.groupBy("cluster").agg(*[F.avg(c) for c in z]).orderBy("cluster").drop("cluster").collect()]
    own = seg.nearest_centre(z, means, list(range(len(means))))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"),
                   F.sum(F.col("cluster").isNull().cast("bigint")).alias("unlabelled"),
                   F.sum((own != F.col("cluster")).cast("bigint")).alias("nearer_elsewhere"))


@query("seg_traffic_level", """SELECT COUNT(*) AS n, CAST(3 AS BIGINT) AS levels, true AS ascending FROM traffic_hourly""")
def seg_traffic_level(spark, d):
    rows = traffic_hourly(spark, d).withColumn("hour", F.hour("ts"))
    out = seg.traffic_level(rows)
    mean = {v: F.avg(F.when(F.col("traffic_level") == v, F.col("total_vehicles"))) for v in seg.LEVELS}
    return out.agg(F.count("traffic_level").alias("n"), F.count_distinct("traffic_level").alias("levels"),
                   ((mean["Free"] <= mean["Moderate"]) & (mean["Moderate"] <= mean["Peak"])).alias("ascending"))


@query("clf_random_forest", """WITH m AS (SELECT COUNT(*) AS n, CAST(ceil(COUNT(*) * 0.2) AS BIGINT) AS held FROM (SELECT DISTINCT year(start_date), month(start_date) FROM passenger_weekly))
SELECT n - held AS n_train, held AS n_test, CAST(0 AS BIGINT) AS bad, CAST(5 AS BIGINT) AS report_rows, CAST(held AS DOUBLE) AS support, true AS learned FROM m""")
def clf_random_forest(spark, d):
    return forest_summary(pl.segment_and_classify(series_history(spark, d), C6, W6, ["year", "month"], stratified=False))


@query("clf_random_forest_stratified", """WITH m AS (SELECT COUNT(*) AS n, CAST(ceil(COUNT(*) * 0.2) AS BIGINT) AS held FROM (SELECT DISTINCT year(start_date), month(start_date) FROM passenger_weekly))
SELECT n - held AS n_train, held AS n_test, CAST(0 AS BIGINT) AS bad, CAST(5 AS BIGINT) AS report_rows, CAST(held AS DOUBLE) AS support, true AS learned FROM m""")
def clf_random_forest_stratified(spark, d):
    return forest_summary(pl.segment_and_classify(series_history(spark, d), C6, W6, ["year", "month"]))


def forest_summary(out):
    """``learned``: on the training rows the forest is right more often than the larger class is frequent."""
    n_all = out.labelled.agg(F.count(F.lit(1)).alias("n_all"))
    test = out.test.agg(F.count(F.lit(1)).alias("n_test"), F.sum((~F.col("prediction").isin(0, 1)).cast("bigint")).alias("bad"))
    report = out.report.agg(F.count(F.lit(1)).alias("report_rows"), F.max("support").alias("support"))
    hit, y = F.avg((F.col("prediction") == F.col("high_traffic")).cast("double")), F.avg(F.col("high_traffic").cast("double"))
    better = out.train.agg((hit > F.greatest(y, 1 - y)).alias("learned"))
    one = test.select("*", better.scalar().alias("learned"), n_all.scalar().alias("n_all"), report.select("report_rows").scalar().alias("report_rows"),
                      report.select("support").scalar().alias("support"))
    return one.select((F.col("n_all") - F.col("n_test")).alias("n_train"), "n_test", "bad", "report_rows", "support", "learned")


# A rule instead of a model: months from May to August are said to be busy.
@query("eval_class_report", f"""WITH s AS (SELECT month, {' + '.join(f'coalesce({c}, 0)' for c in C6)} AS tot FROM carrier_monthly),
x AS (SELECT CASE WHEN tot >= (SELECT quantile_cont(CAST(tot AS DOUBLE), 0.75) FROM s) THEN 1 ELSE 0 END AS l, CASE WHEN month BETWEEN 5 AND 8 THEN 1 ELSE 0 END AS p FROM s),
k AS (SELECT c, COUNT(*) FILTER (l = c AND p = c) AS hit, COUNT(*) FILTER (l = c) AS real, COUNT(*) FILTER (p = c) AS said FROM x, (VALUES (0), (1)) v(c) GROUP BY c),
m AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(hit / nullif(said, 0), 0.0) AS precision, coalesce(hit / nullif(real, 0), 0.0) AS recall, hit, real FROM k),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m),
z AS (SELECT class, precision, recall, f1, CAST(real AS DOUBLE) AS support FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(real), sum(hit) / sum(real), sum(hit) / sum(real), sum(hit) / sum(real) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(real) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * real) / sum(real), sum(recall * real) / sum(real), sum(f1 * real) / sum(real), sum(real) FROM f)
SELECT class, CAST(ROUND(precision, 4) AS DOUBLE) AS precision, CAST(ROUND(recall, 4) AS DOUBLE) AS recall, CAST(ROUND(f1, 4) AS DOUBLE) AS f1_score, CAST(ROUND(support, 4) AS DOUBLE) AS support FROM z""")
def eval_class_report(spark, d):
    rows = seg.high_traffic(carrier_monthly(spark, d), C6).withColumn("prediction", F.col("month").between(5, 8).cast("int"))
    return rounded(ev.class_report(rows, "high_traffic"), ["precision", "recall", "f1_score", "support"])


# --- hourly vehicles ---------------------------------------------------------------------------------

@query("fc_facility_hourly", """SELECT facility, CAST(6 * 24 AS BIGINT) AS n, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS missing, true AS learned
FROM traffic_hourly WHERE ts < TIMESTAMP '2024-01-25' GROUP BY facility""")
def fc_facility_hourly(spark, d):
    rows = t.traffic(spark, d).withColumn("time", (F.floor(F.col("time") / 100) * 100).cast("int"))
    hourly = pl.hourly_vehicles([rows], t.weather(spark, d), t.VEHICLES, W6)
    out = pl.facility_forecast(hourly, W6, "2024-01-24", "2024-01-25", "2024-01-30", fc.BoostParams(5, 0.05, 4))
    v = F.col("total_vehicles")
    ahead = out.forecast.groupBy("facility").agg(F.count(F.lit(1)).alias("n"), F.sum((v < 0).cast("bigint")).alias("negative"),
                                                 F.sum(v.isNull().cast("bigint")).alias("missing"))
    return ahead.join(learned(out.fitted, "facility", "label", "predicted"), "facility")
