import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastops.operators import quantiles as q

PROBS = {"p05": 0.05, "p25": 0.25, "third": 1 / 3, "half": 0.5, "p95": 0.95, "lo": 0.0, "hi": 1.0}


@pytest.mark.parametrize("kind", ["counts", "normal", "constant", "wide", "huge", "band", "tiny", "zeros"])
def test_matches_linear_interpolation(spark, kind):
    rng = np.random.default_rng(11)
    make = {"counts": lambda n: rng.integers(0, 300, n).astype(float), "normal": lambda n: rng.normal(0, 5, n),
            "constant": lambda n: np.full(n, 7.0), "wide": lambda n: np.sign(rng.normal(size=n)) * 10 ** rng.uniform(-8, 12, n),
            "huge": lambda n: 1e9 + rng.integers(0, 50, n).astype(float),
            "tiny": lambda n: np.sign(rng.normal(size=n)) * 10 ** rng.uniform(-300, -9, n), "zeros": lambda n: rng.choice([0.0, -1e-12, 1e-12, 3.0], n),
            "band": lambda n: -rng.uniform(1000, 1000.3, n)}[kind]
    groups = {"hot": make(2000), "two": make(2), "one": make(1), "odd": make(37)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in q.exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in PROBS.items():
            np.testing.assert_allclose(got[g][name], np.quantile(vs, p), rtol=1e-9, atol=0 if kind == "tiny" else 1e-9, err_msg=f"{g} {name}")
    small = {r.g: r for r in q.small_group_quantiles(df.filter("g <> 'none'"), ["g"], "v", PROBS).collect()}
    for g in groups:
        np.testing.assert_allclose([small[g][n] for n in PROBS], [got[g][n] for n in PROBS])


def test_missing_key_and_no_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r.g: r.m for r in q.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()} == {None: 2.0, "a": 5.0}
    assert q.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 3.0


def test_iqr_filter(spark):
    rows = [("a", float(v)) for v in [10, 11, 12, 13, 14, 100]] + [("b", 100.0), ("b", 101.0), (None, 1.0)]
    out = q.iqr_filter(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    assert sorted((r.g, r.v) for r in out.collect()) == [("a", 10.0), ("a", 11.0), ("a", 12.0), ("a", 13.0), ("a", 14.0), ("b", 100.0), ("b", 101.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_group_is_never_gathered_by_the_percentile_buffer(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = q.exact_quantiles(df, ["g"], "v", {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_tiny_values_do_not_share_a_cell(spark):
    df = spark.range(2000).select((F.lit(1e-30) * (F.col("id") + 1)).alias("v"))
    bucket, cell = q._buckets_and_cells(F.col("v"))
    assert df.select(bucket, cell).distinct().count() == 2000
