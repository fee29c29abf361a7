import dataclasses
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastops.operators import compare as c
from forecastops.operators import evaluate as ev
from forecastops.operators import forecast as fc
from forecastops.operators import segments as seg
from forecastops.plans import pipelines as pl

WEATHER = ["w1", "w2"]


@pytest.fixture(scope="module")
def monthly(spark):
    rng = np.random.default_rng(4)
    rows = [(y, m, float(100 + 10 * m + rng.integers(0, 9)), float(900 - 5 * m + rng.integers(0, 40)), float(m), float(rng.integers(0, 5)))
            for y in range(1995, 2001) for m in range(1, 13)]
    return pl.prepare_series(spark.createDataFrame(rows, "year int, month int, s1 double, s2 double, w1 double, w2 double"), ["s1", "s2"], WEATHER)


def test_linear_fit_equals_least_squares(spark):
    rng = np.random.default_rng(8)
    x, level = rng.normal(size=300), rng.choice(["a", "b", "c"], 300)
    y = 3 * x + np.select([level == "a", level == "b"], [10.0, 20.0], 30.0) + rng.normal(size=300)
    df = spark.createDataFrame([(float(i), str(v), float(t)) for i, v, t in zip(x, level, y)], "x double, level string, y double")
    fit = fc.fit_linear(df, ["x"], "y", "level")
    design = np.column_stack([x, level == "a", level == "b", level == "c"]).astype(float)
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    want = {(float(i), str(v)): p for i, v, p in zip(x, level, design @ beta)}
    rows = fit.score(df).collect()
    np.testing.assert_allclose([r.predicted for r in rows], [want[r.x, r.level] for r in rows], rtol=1e-6, atol=1e-6)
    table = fit.table(spark).collect()
    assert [(r.part, r.feature) for r in table] == [("numeric", "x"), ("level", "level_c"), ("level", "level_b"), ("level", "level_a")]
    assert sum(r.coefficient for r in table[1:]) == pytest.approx(0, abs=1e-9)
    unseen = spark.createDataFrame([(0.0, "new", 0.0)], df.schema)
    assert fit.score(unseen).first().predicted == pytest.approx(fit.intercept)


@pytest.mark.parametrize("mode", ["per_series", "pooled"])
def test_series_forecast(monthly, mode):
    grid = [fc.BoostParams(n_estimators=3, max_depth=2)]
    out = pl.series_forecast(monthly, ["s1", "s2"], WEATHER, 2000, "2001-01-01", "2002-12-01", grid, mode=mode)
    assert out.metrics.count() == 2 and out.metrics.filter("mape < 100").count() == 2
    assert out.actual_vs_predicted.count() == 24
    rows = out.forecast.collect()
    assert len(rows) == 48
    assert all(r.low - 1e-9 <= r.forecast / 1.1 <= r.high + 1e-9 for r in rows)
    assert out.combined.count() == 72 + 24
    assert out.combined.columns == ["month_start", "year", "month", "s1", "s2", "w1", "w2"]
    assert out.combined.dropna().count() == 96


def test_grid_search_picks_the_lowest_mean_error(monthly):
    grid = fc.param_grid(n_estimators=[1, 8], learning_rate=[0.3], max_depth=[3])
    out = pl.series_forecast(monthly, ["s1"], WEATHER, 2000, "2001-01-01", "2001-12-01", grid, n_splits=2)
    assert out.params["s1"] in grid
    assert len(pl.GRID_TERMINAL_A) == 32 and len(pl.GRID_TERMINAL_B) == 1


def test_cross_validation_folds(spark):
    df = spark.range(20).select(F.col("id").alias("position"), F.col("id").cast("double").alias("x"), F.when(F.col("id") < 5, 1.0).otherwise(9.0).alias("y"))
    best, scores = fc.time_series_cv(df, ["x"], "y", "position", 3, [fc.BoostParams(2, 0.1, 2, 1.0, 1.0)])
    assert [s[1] for s in scores] == [1, 2, 3]
    # The first fold trains on rows 0-4 only, all of them 1: it cannot know the later level.
    assert scores[0][2] == pytest.approx(64.0)


@pytest.mark.parametrize("stratified", [True, False])
def test_segments(monthly, stratified):
    out = pl.segment_and_classify(monthly, ["s1", "s2"], WEATHER, ["year", "month"], stratified=stratified, trees=5)
    assert out.labelled.filter("high_traffic = 1").count() == 18
    assert out.labelled.select("cluster").distinct().count() == 3
    report = {r["class"]: r for r in out.report.collect()}
    assert {"0", "accuracy", "macro avg", "weighted avg"} <= set(report)
    n_test = out.test.count()
    assert report["macro avg"].support == n_test and (n_test == 15 or not stratified)


def test_class_report_without_hits(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: tuple(r)[1:] for r in ev.class_report(df).collect()}
    assert report["1"] == (0.0, 0.0, 0.0, 1.0)
    assert report["0"] == pytest.approx((2 / 3, 1.0, 0.8, 2.0))
    assert report["accuracy"] == pytest.approx((2 / 3,) * 4)
    assert report["macro avg"] == pytest.approx((1 / 3, 0.5, 0.4, 3.0))
    assert report["weighted avg"] == pytest.approx((4 / 9, 2 / 3, 1.6 / 3, 3.0))


def test_metrics_skip_missing_and_zero(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0), ("a", 0.0, 2.0), ("a", None, 1.0), ("a", 5.0, None)], "s string, actual double, predicted double")
    r = ev.forecast_metrics(df, ["s"]).first()
    assert (r.mae, r.rmse, r.mape) == (2.0, 2.0, pytest.approx(20.0))


def test_traffic_levels_follow_volume(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v + rng.normal()), int(h)) for v, h in [(10, 3), (200, 12), (400, 18)] for _ in range(50)] + [(None, 5), (3.0, None)]
    out = seg.traffic_level(spark.createDataFrame(rows, "total_vehicles double, hour int"))
    means = {r.traffic_level: r.m for r in out.groupBy("traffic_level").agg(F.avg("total_vehicles").alias("m")).collect()}
    assert means["Free"] < means["Moderate"] < means["Peak"]
    assert out.filter("traffic_level is null").count() == 2 and out.count() == len(rows)


def test_tiers_skip_flat_groups(spark):
    rows = [("a", "Weekday", h, float(h)) for h in range(24)] + [("b", "Weekday", h, float(h % 2)) for h in range(24)]
    tiers = seg.tercile_tiers(spark.createDataFrame(rows, "facility string, day_type string, hour int, v double"), ["facility", "day_type"], "v")
    counts = {r.traffic_level: r["count"] for r in tiers.groupBy("traffic_level").count().collect()}
    assert counts == {"Free": 8, "Moderate": 8, "Peak": 8}


def test_labels(spark):
    df = spark.createDataFrame([(0, "p_x"), (9, "y")], "k int, n string").coalesce(1)
    assert [tuple(r) for r in df.select(seg.code_labels("k", {0: "Free"}), seg.strip_prefix("n", "p_")).collect()] == [("Free", "x"), (None, "y")]


@pytest.fixture(scope="module")
def hourly(spark):
    rng = np.random.default_rng(6)
    rows = [(f, datetime(2023, 12, 1) + timedelta(hours=h), float(s * (10 + (h % 24)) + rng.integers(0, 5)), float(h % 3), None)
            for f, s in (("a", 1), ("b", 4)) for h in range(24 * 40)]
    return spark.createDataFrame(rows, "facility string, ts timestamp_ntz, total_vehicles double, w1 double, w2 double")


@pytest.mark.parametrize("mode", ["pooled", "per_facility"])
def test_facility_forecast(hourly, mode):
    out = pl.facility_forecast(hourly, WEATHER, "2024-01-05", "2024-01-06", "2024-01-08", fc.BoostParams(10, 0.3, 4), mode=mode)
    rows = out.forecast.collect()
    assert len(rows) == 2 * 3 * 24 and all(r.total_vehicles >= 0 for r in rows)
    n = 36 * 24
    assert {r.facility: r.n for r in out.rmse.collect()} == {"a": int(np.ceil(n * 0.2)), "b": int(np.ceil(n * 0.2))}
    by = {f: np.mean([r.total_vehicles for r in rows if r.facility == f]) for f in "ab"}
    assert by["b"] > 2 * by["a"]
    tiers, top = pl.busiest_hours(out.forecast)
    assert top.groupBy("facility", "day_type").count().filter("count <> 3").count() == 0
    assert set(top.columns) == {"facility", "day_type", "hour", "total_vehicles", "traffic_level", "rank"}


def test_hourly_vehicles_from_raw_files(spark):
    def raw(day):
        rows = [(f"2024-01-{day:02d}", t, "f", "3", "x", None, "2") for t in ("0", "100", "2400", "bad")]
        return spark.createDataFrame(rows, "date string, time string, facility string, a string, b string, c string, d string")
    weather = spark.createDataFrame([(date(2024, 1, 1), 5.0)], "date date, w1 double")
    out = pl.hourly_vehicles([raw(1), raw(2)], weather, ["a", "b", "c", "d"], ["w1"]).orderBy("ts").collect()
    assert [(r.ts, r.total_vehicles, r.w1) for r in out] == [
        (datetime(2024, 1, 1, 0), 5.0, 5.0), (datetime(2024, 1, 1, 1), 5.0, 5.0), (datetime(2024, 1, 2, 0), 5.0, None), (datetime(2024, 1, 2, 1), 5.0, None)]


def test_recovery(spark):
    def year(y, scale):
        return [("f", datetime(y, m, d, h), float(scale * (10 + h + d))) for m in (3, 7) for d in range(1, 15) for h in range(24)]
    rows = spark.createDataFrame(year(2019, 100), "facility string, ts timestamp_ntz, total_vehicles double")
    ahead = spark.createDataFrame(year(2025, 105), rows.schema)
    r = pl.two_year_recovery(rows, ahead, 2019, 2025, trim_warmup=False).first()
    assert (r.percent_change, r.trend, r.summer_trend) == (5.0, "Increase", "Increase")
    assert r.rush_change > 5 and r.rush_trend == "Sharpened"
    trimmed = pl.two_year_recovery(rows, ahead, 2019, 2025).first()
    assert trimmed.avg_base > r.avg_base


def test_rush_labels_at_the_boundary(spark):
    df = spark.createDataFrame([(5.0,), (4.99,), (5.01,), (-4.99,), (-5.0,)], "x double").coalesce(1)
    assert [r[0] for r in df.select(c.rush_label(F.col("x"))).collect()] == ["Reduced", "Flattened", "Sharpened", "Flattened", "Reduced"]


def test_holiday_weeks(spark):
    weeks = spark.createDataFrame([(date(2024, 12, 23),), (date(2024, 12, 30),), (date(2024, 12, 16),), (date(2024, 1, 1),)], "week date").coalesce(1)
    assert [r.holiday_week for r in c.mark_holidays(weeks).collect()] == [1, 1, 0, 1]


def test_passenger_forecast_repeats_every_year(spark):
    rows = [(y, m, f, t, 100.0 * t + (50 if f == "a" else 0), None if m == 5 else 1.0, 2.0, float(m))
            for y in (1999, 2000) for m in range(1, 13) for f in "ab" for t in (6, 12, 18)]
    df = spark.createDataFrame(rows, "year int, month int, facility string, time int, c1 double, c2 double, c3 double, w1 double")
    hours = pl.prepare_passenger_hours(df, ["c1", "c2", "c3"], ["w1"])
    assert hours.count() == len(rows)
    out = pl.passenger_hour_forecast(hours, ["w1"], 2000, (2025, 2026))
    cells = out.forecast.groupBy("month", "time", "facility").agg(F.count(F.lit(1)).alias("n"), (F.max("predicted_passengers") - F.min("predicted_passengers")).alias("d"))
    assert cells.count() == 12 * 3 * 2 and cells.filter("n <> 2 or d > 1e-9").count() == 0


def test_linear_fit_with_many_levels(spark):
    df = spark.range(20_000).selectExpr("CAST(id % 5000 AS STRING) AS level", "CAST(id DIV 5000 AS DOUBLE) AS x", "2.0 * (id DIV 5000) + id % 5000 AS y")
    fit = fc.fit_linear(df, ["x"], "y", "level")
    assert fit.coefficients == pytest.approx([2.0]) and fit.effects.count() == 5000
    assert fit.score(df).agg(F.max(F.abs(F.col("y") - F.col("predicted")))).first()[0] < 1e-6


def test_pooled_keeps_series_without_a_positive_level_and_scores_every_setting(spark):
    rows = [(y, m, float(100 + 10 * m), 0.0, -5.0 - m, float(m), 1.0) for y in range(1995, 2001) for m in range(1, 13)]
    history = pl.prepare_series(spark.createDataFrame(rows, "year int, month int, s1 double, s2 double, s3 double, w1 double, w2 double"),
                                ["s1", "s2", "s3"], WEATHER, zero_is_missing=False)
    grid = [fc.BoostParams(n_estimators=3, max_depth=d) for d in (1, 2)]
    out = pl.series_forecast(history, ["s1", "s2", "s3"], WEATHER, 2000, "2001-01-01", "2001-12-01", grid, mode="pooled")
    assert {r.series for r in out.metrics.collect()} == {"s1", "s2", "s3"} and out.forecast.count() == 36
    assert len(out.fold_scores) == 6 and {s[1] for s in out.fold_scores} == set(grid)


def test_facilities_without_training_rows_are_skipped(spark):
    hours = spark.range(24 * 30).selectExpr("'a' AS facility", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts",
                                            "CAST(10 + id % 24 AS BIGINT) AS total_vehicles", "1.0 AS w1", "2.0 AS w2")
    one = spark.sql("SELECT 'b' AS facility, TIMESTAMP_NTZ '2024-01-03 00:00:00' AS ts, 7L AS total_vehicles, 1.0 AS w1, 2.0 AS w2")
    out = pl.facility_forecast(hours.unionByName(one), WEATHER, "2024-01-30", "2024-02-01", "2024-02-02", fc.BoostParams(5, 0.3, 3), mode="per_facility")
    assert {r.facility for r in out.forecast.select("facility").distinct().collect()} == {"a"} and out.forecast.count() == 48
    mean = out.validation.crossJoin(out.fitted.agg(F.avg("label").alias("m"))).agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("m"), 2)))).first()[0]
    assert out.rmse.first().rmse < mean


def test_long_prefixed_text_keeps_its_end(spark):
    out = spark.createDataFrame([("p_" + "x" * 1500,)], "c string").select(seg.strip_prefix("c", "p_"))
    assert len(out.first()[0]) == 1500


CONSTANT_FAILS = ["fc_hourly_lr", "fc_series_gbt", "fc_history_union", "clf_random_forest", "fc_facility_hourly"]


@pytest.mark.parametrize("name", CONSTANT_FAILS)
def test_checks_notice_a_constant_model(spark, monkeypatch, name):
    import oracle

    from forecastops.catalog import ORACLES, QUERIES

    def constant(df, name="predicted"):
        return df.withColumn(name, F.lit(0.0))

    def constant_many(train, features, labels, params):
        return lambda df: df.withColumns({f"{c}__p": F.lit(0.0) for c in labels})

    real = fc.fit_linear
    monkeypatch.setattr(pl, "fit_linear", lambda *a, **k: dataclasses.replace(real(*a, **k), score=constant))
    monkeypatch.setattr(pl, "fit_boosted", lambda *a, **k: constant)
    monkeypatch.setattr(pl, "fit_many", constant_many)
    monkeypatch.setattr(pl, "fit_forest", lambda *a, **k: lambda df: df.withColumn("prediction", F.lit(0)))
    con = oracle.connect("/root/testdata/sf0.001")
    assert oracle.differences(QUERIES[name](spark, "/root/testdata/sf0.001"), con, ORACLES[name])


def test_moments_add_up_to_the_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1000, 3, (400, 3))
    rows = spark.createDataFrame([(k % 7, *map(float, v), float(5 + v @ [1.5, -2, 0.25] + rng.normal())) for k, v in enumerate(x)] + [(0, None, 1.0, 1.0, 1.0)],
                                 "day int, a double, b double, c double, y double")
    features = ["a", "b", "c"]
    parts = [fc.moment_table(rows.where(F.col("day") == d), features, "y") for d in range(7)]
    got = {r.feature: r.coefficient for r in fc.solve_moments(fc.add_moments(parts), features).collect()}
    fit = fc.fit_linear(rows, features, "y")
    np.testing.assert_allclose([got[f] for f in features], fit.coefficients, rtol=1e-8)
    assert got["intercept"] == pytest.approx(fit.intercept, abs=1e-8 * 1000)  # the difference of means near 1000
    grouped = fc.add_moments([fc.moment_table(rows, features, "y", ["day"])], ["day"])
    assert grouped.count() == 7 and grouped.agg(F.sum("n")).first()[0] == 400
    assert fc.solve_moments(fc.moment_table(rows.limit(0), features, "y"), features).count() == 0


def test_one_fit_answers_for_fewer_trees(spark):
    rows = spark.createDataFrame([(k, float(k % 5), float(k % 3), float((k * 7) % 11 + k % 5)) for k in range(40)], "position int, a double, b double, y double")
    grid = fc.param_grid(n_estimators=[2, 5], max_depth=[2], subsample=[0.8, 1.0])
    assert [[p.n_estimators for p in g] for g in fc.staged_settings(grid)] == [[2, 5], [2, 5]]
    best, scores = fc.time_series_cv(rows, ["a", "b"], "y", "position", 2, grid, monthly=True)
    assert len(scores) == 8 and best in grid
    alone = [s for p in grid for s in fc.time_series_cv(rows, ["a", "b"], "y", "position", 2, [p], monthly=True)[1]]
    assert [(p, f) for p, f, _ in scores] == [(p, f) for p, f, _ in alone]
    np.testing.assert_allclose([e for _, _, e in scores], [e for _, _, e in alone], rtol=1e-9)


def test_search_of_a_series_too_short_for_its_folds(spark):
    grid = fc.param_grid(n_estimators=[2], max_depth=[2])
    short = spark.createDataFrame([(k, 1.0, float(k)) for k in range(3)], "position int, a double, y double")
    assert fc.time_series_cv(short, ["a"], "y", "position", 5, grid) == (grid[0], [])
    gap = spark.createDataFrame([(k, 1.0, float(k) if k > 9 else None) for k in range(20)], "position int, a double, y double")
    assert [fold for _, fold, _ in fc.time_series_cv(gap, ["a"], "y", "position", 3, grid)[1]] == [3]  # nothing to train on before


def test_pooled_search_chooses_for_each_series(spark, monthly, tmp_path):
    grid = fc.param_grid(n_estimators=[1, 4], max_depth=[1, 3], subsample=[1.0])
    out = pl.series_forecast(monthly, ["s1", "s2"], WEATHER, 2000, "2001-01-01", "2001-03-01", grid, 2, mode="pooled")
    mean = {(s, p): np.mean([e for t, q, _, e in out.series_scores if (t, q) == (s, p)]) for s in ("s1", "s2") for p in grid}
    assert len(out.series_scores) == 2 * 4 * 2 and all(mean[s, out.params[s]] == min(mean[s, q] for q in grid) for s in ("s1", "s2"))
    got = {(r.series, r.month_start): r.predicted for r in out.fitted.collect()}
    assert len(got) == 2 * 60
    for s in ("s1", "s2"):  # the same as one model of that setting over all series
        alone = pl.series_forecast(monthly, ["s1", "s2"], WEATHER, 2000, "2001-01-01", "2001-03-01", [out.params[s]], 2, mode="pooled")
        for r in alone.fitted.where(F.col("series") == s).collect():
            assert got[s, r.month_start] == pytest.approx(r.predicted, rel=1e-9)


def test_a_search_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(s, k, float(k % 5), float((k * 7) % 11 + k % 5)) for k in range(40) for s in ("x", "y")], "series string, position int, a double, y double")
    grid, folder = fc.param_grid(n_estimators=[2], max_depth=[1, 2]), str(tmp_path / "search")
    first = sorted(map(tuple, fc.series_errors(rows, ["a"], "y", "position", 2, grid, folder=folder).collect()))
    assert len(first) == 2 * 2 * 2
    monkeypatch.setattr(fc.BoostParams, "estimator", lambda *a: pytest.fail("fitted again"))
    assert sorted(map(tuple, fc.series_errors(rows, ["a"], "y", "position", 2, grid, folder=folder).collect())) == first
    with pytest.raises(pytest.fail.Exception):
        fc.series_errors(rows, ["a"], "y", "position", 2, fc.param_grid(n_estimators=[3], max_depth=[1]), folder=folder)


def test_forest_fits_and_scores_rows_with_missing_features(spark):
    # The label is whether x is missing, NULL or NaN; w has no value at all.
    x = [None, float("nan"), 0.0, 1.0, -5.0, 3.0]
    rows = spark.createDataFrame([(k, x[k % 6], None, int(k % 6 < 2)) for k in range(60)], "k int, x double, w double, y int")
    got = seg.fit_forest(rows, ["x", "w"], "y", trees=5)(rows).collect()
    assert len(got) == 60 and all(r.prediction == r.y for r in got)


def segments_without_snow(spark, stratified):
    """Months whose w2 is zero throughout, so that imputation finds no value for it."""
    rows = [(y, m, float(100 + 10 * m + y % 3), float(900 - 5 * m), float(m), 0.0) for y in range(1995, 2000) for m in range(1, 13)]
    history = pl.prepare_series(spark.createDataFrame(rows, "year int, month int, s1 double, s2 double, w1 double, w2 double"), ["s1", "s2"], WEATHER)
    assert history.where("w2 IS NOT NULL").isEmpty()
    return pl.segment_and_classify(history, ["s1", "s2"], WEATHER, ["year", "month"], stratified=stratified, trees=5)


def check_whole(out):
    assert (out.train.count(), out.test.count()) == (48, 12)
    assert {r["class"]: r for r in out.report.collect()}["macro avg"].support == 12
    larger = max(r["count"] for r in out.train.groupBy("high_traffic").count().collect())
    assert out.train.where("prediction = high_traffic").count() > larger


def test_segments_of_weather_without_a_value(spark):
    check_whole(segments_without_snow(spark, False))


def test_stratified_segments_of_weather_without_a_value(spark):
    out = segments_without_snow(spark, True)
    check_whole(out)
    assert sorted(map(tuple, out.test.groupBy("high_traffic").count().collect())) == [(0, 9), (1, 3)]
