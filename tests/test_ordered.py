from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forecastops.operators import ordered as o
from forecastops.operators import splits


@pytest.fixture(scope="module")
def hours():
    """One facility holds most rows; hours are missing at random."""
    rng = np.random.default_rng(5)
    rows = []
    for facility, n in {"hot": 900, "small": 40, "tiny": 3}.items():
        start = datetime(2024, 1, 1)
        for h in sorted(rng.choice(n * 2, n, replace=False)):
            rows.append((facility, start + timedelta(hours=int(h)), float(rng.integers(0, 500))))
    return pd.DataFrame(rows, columns=["facility", "ts", "v"])


def to_spark(spark, pdf, schema):
    def plain(v):
        return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    rows = [tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(7)


SCHEMA = "facility string, ts timestamp_ntz, v double"


@pytest.mark.parametrize("by_day", [True, False])
def test_positions(spark, hours, by_day):
    df = to_spark(spark, hours, SCHEMA)
    out = o.with_positions(df, ["facility"], ["ts"], F.to_date("ts") if by_day else None).toPandas()
    out = out.sort_values(["facility", "ts"])
    expected = out.groupby("facility").cumcount()
    assert (out["position"] == expected).all() and len(out) == len(hours)


@pytest.mark.parametrize("chunk", [24, 50, 8192])
def test_lags_match_pandas_for_any_chunk(spark, hours, chunk):
    df = to_spark(spark, hours, SCHEMA)
    out = o.lag_features(df, ["facility"], "ts", "v", slice_by=F.to_date("ts"), trim_warmup=False, chunk_rows=chunk).toPandas()
    out = out.sort_values(["facility", "ts"]).reset_index(drop=True)
    e = hours.sort_values(["facility", "ts"]).reset_index(drop=True)
    g = e.groupby("facility")["v"]
    for name, want in {"lag_1h": g.shift(1), "lag_24h": g.shift(24),
                       "rolling_mean_24h": g.transform(lambda x: x.rolling(24).mean())}.items():
        np.testing.assert_allclose(out[name].astype(float), want, err_msg=name)
    trimmed = o.lag_features(df, ["facility"], "ts", "v", slice_by=F.to_date("ts"), chunk_rows=chunk)
    assert trimmed.count() == (900 - 24) + (40 - 24)


def test_rolling_needs_a_full_window(spark):
    rows = [("a", datetime(2024, 1, 1, 0) + timedelta(hours=i), None if i == 30 else float(i)) for i in range(60)]
    out = o.lag_features(spark.createDataFrame(rows, SCHEMA), ["facility"], "ts", "v", slice_by=F.to_date("ts"), trim_warmup=False)
    got = [r[0] for r in out.orderBy("ts").select("rolling_mean_24h").collect()]
    want = pd.Series([r[2] for r in rows], dtype=float).rolling(24).mean()
    np.testing.assert_allclose(np.array(got, dtype=float), want)


@pytest.mark.parametrize("sliced", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_interpolation_matches_pandas(spark, sliced, seed):
    rng = np.random.default_rng(seed)
    n = 400
    pdf = pd.DataFrame({"d": [date(2020, 1, 1) + timedelta(days=i) for i in range(n)], "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.6, "a"] = np.nan
    pdf.loc[:70, "b"] = np.nan  # whole slices without a value, at both ends and inside
    pdf.loc[200:330, "b"] = np.nan
    pdf.loc[390:, "b"] = np.nan
    df = to_spark(spark, pdf, "d date, a double, b double")
    out = o.interpolate_linear(df, ["d"], ["a", "b"], slice_by=F.trunc("d", "month") if sliced else None).toPandas().sort_values("d")
    for c in ("a", "b"):
        np.testing.assert_allclose(out[c].astype(float).to_numpy(), pdf[c].interpolate(method="linear").to_numpy(), err_msg=c)


@pytest.mark.parametrize("sliced", [True, False])
def test_interpolation_by_key_stays_inside_a_series(spark, sliced):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(k, date(2020, 1, 1) + timedelta(days=i), rng.normal()) for k, n in (("x", 200), ("y", 10), (None, 10)) for i in range(n)],
                       columns=["k", "d", "a"])
    pdf.loc[rng.random(len(pdf)) < 0.5, "a"] = np.nan
    df = to_spark(spark, pdf, "k string, d date, a double")
    out = o.interpolate_linear(df, ["d"], ["a"], keys=["k"], slice_by=F.trunc("d", "month") if sliced else None).toPandas()
    assert len(out) == len(pdf)
    for k in ("x", "y"):
        want = pdf[pdf.k == k].sort_values("d")["a"].interpolate(method="linear")
        np.testing.assert_allclose(out[out.k == k].sort_values("d")["a"].astype(float), want)
    missing_key = out[out.k.isna()].sort_values("d")["a"].astype(float)
    np.testing.assert_allclose(missing_key, pdf[pdf.k.isna()].sort_values("d")["a"].interpolate(method="linear"))


def test_top_k_and_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("a", 3, 9), ("b", 1, 1)], "k string, h int, v int")
    got = o.top_k(df, ["k"], [F.desc("v"), "h"], 2, rank="r").orderBy("k", "r").collect()
    assert [(r.k, r.h, r.r) for r in got] == [("a", 2, 1), ("a", 3, 2), ("b", 1, 1)]
    assert o.first_per_group(df, ["k"], ["h"]).count() == 2


@pytest.mark.parametrize("n", [1, 2, 5, 99, 100])
def test_chronological_split_counts(spark, n):
    rows = [("a", datetime(2024, 1, 1) + timedelta(hours=7 * i)) for i in range(n)]
    out = splits.split_chronological(spark.createDataFrame(rows, "facility string, ts timestamp_ntz"), ["facility"], "ts", F.to_date("ts"))
    marks = [r.split for r in out.orderBy("ts").collect()]
    n_valid = int(np.ceil(n * 0.2))
    assert marks == ["train"] * (n - n_valid) + ["valid"] * n_valid


def test_stratified_split_keeps_proportions(spark):
    df = spark.range(1003).withColumn("label", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 97 == 1, 2).otherwise(0))
    out = splits.split_stratified(df, "label", ["id"])
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    test = {k[0]: v for k, v in counts.items() if k[1] == "test"}
    sizes = {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    assert sum(test.values()) == int(np.ceil(1003 * 0.2))
    assert all(abs(test[k] - 0.2 * n) < 1 for k, n in sizes.items())
    again = splits.split_stratified(df.repartition(5), "label", ["id"])
    assert out.exceptAll(again).count() == 0


def test_random_split_is_exact_and_does_not_shuffle_the_rows(spark):
    out = splits.split_random(spark.range(20003), ["id"])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("split = 'test'").count() == 4001


@pytest.mark.parametrize("n,k", [(82, 3), (60, 5), (7, 3)])
def test_folds_expand(spark, n, k):
    folds = splits.expanding_folds(spark.range(n).withColumn("g", F.lit("a")), ["g"], k).orderBy("fold").collect()
    size = n // (k + 1)
    assert [f.train_end for f in folds] == [n - (k - i) * size for i in range(k)]
    assert all(f.test_start == f.train_end and f.test_end == f.test_start + size for f in folds)
    assert folds[-1].test_end == n
