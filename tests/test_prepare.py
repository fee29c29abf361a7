from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from forecastops.operators import prepare as p
from forecastops.sources import readers, sinks, spines
from forecastops.session import scratch_path


@pytest.mark.parametrize("stat", ["median", "mean"])
@pytest.mark.parametrize("monthly", [True, False])
def test_imputation_matches_pandas(spark, stat, monthly):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"month": np.tile(np.arange(1, 13), 5), "a": rng.integers(0, 4, 60).astype(float), "b": rng.normal(size=60)})
    pdf.loc[pdf.month == 7, "a"] = 0.0  # a season without a single value
    pdf.loc[rng.random(60) < 0.3, "b"] = np.nan
    want = pdf.copy()
    for c in ("a", "b"):
        want[c] = want[c].replace(0, np.nan)
        want[c] = want.groupby("month")[c].transform(lambda x: x.fillna(getattr(x, stat)()))
        want[c] = want[c].fillna(getattr(want[c], stat)())
    rows = [(i, int(m), float(a), None if np.isnan(b) else float(b)) for i, (m, a, b) in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "i int, month int, a double, b double")
    got = p.impute_seasonal(df, ["a", "b"], stat=stat, monthly=monthly).orderBy("i").toPandas()
    np.testing.assert_allclose(got["a"], want["a"])
    np.testing.assert_allclose(got["b"], want["b"])


def test_imputation_can_ignore_the_holdout_and_keep_zero(spark):
    df = spark.createDataFrame([(2000, 1, 1.0), (2000, 1, 0.0), (2001, 1, 100.0), (2001, 1, None), (2001, 2, None)], "year int, month int, a double")
    got = p.impute_seasonal(df, ["a"], stat="mean", zero_is_missing=False, fit_filter=F.col("year") == 2000)
    assert sorted(r.a for r in got.collect()) == [0.0, 0.5, 0.5, 1.0, 100.0]


def test_a_thousand_seasons_are_imputed(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("s"), F.when(F.col("id") < 1000, None).otherwise(F.col("id") + 1.0).alias("a"))
    got = p.impute_seasonal(df, ["a"], by="s", stat="mean")
    assert got.count() == 4000 and got.where(F.col("a").isNull()).count() == 0
    filled = {r.s: r.low for r in got.groupBy("s").agg(F.min(F.when(F.col("a") == F.col("s") + 2001, F.col("a"))).alias("low")).collect()}
    assert filled == {s: s + 2001.0 for s in range(1000)}  # the mean of s + 1001, s + 2001 and s + 3001


def test_levels_are_learned_from_the_data(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), ("a",), ("d",)], "k string")
    levels = p.learn_levels(df, "k", limit=3)
    assert levels.levels == ["a", "c", "b"] and levels.left_out == 1
    rows = levels.columns(df, "k_").collect()
    assert {r.k: (r.k_a, r.k_c, r.k_b, r.k_other) for r in rows} == {"a": (1, 0, 0, 0), "c": (0, 1, 0, 0), "b": (0, 0, 1, 0), "d": (0, 0, 0, 1), None: (0, 0, 0, 1)}
    vectors = {r.k: r.v for r in levels.vector(df, "v").collect()}
    assert {k: (v.size, v.indices.tolist()) for k, v in vectors.items()} == {"a": (4, [0]), "c": (4, [1]), "b": (4, [2]), "d": (4, [3]), None: (4, [3])}
    assert p.learn_levels(df.limit(0), "k").levels == []


def test_reshape(spark):
    rows = [("2024-01-06", "930", "f", "1", "x", None, "2"), ("2024-01-08", "2400", "f", "1", "1", "1", "1"), ("bad", "0", "f", None, None, None, None),
            ("2024-01-06", "n/a", "f", "1", "1", "1", "1")]
    out = p.reshape_hourly(spark.createDataFrame(rows, "date string, time string, facility string, a string, b string, c string, d string"), ["a", "b", "c", "d"])
    assert [tuple(r) for r in out.orderBy(F.desc_nulls_last("date")).collect()] == [
        (date(2024, 1, 8), "24:00", "f", 4.0, None, 0, "Weekday"), (date(2024, 1, 6), "09:30", "f", 3.0, 9, 5, "Weekend"),
        (None, "00:00", "f", 0.0, 0, None, "Weekday")]


def test_hourly_grouping_drops_missing_keys(spark):
    rows = [("f", datetime(2024, 1, 1, 5), 1.0, None), ("f", datetime(2024, 1, 1, 5), None, 4.0), (None, datetime(2024, 1, 1, 5), 1.0, 1.0), ("g", datetime(2024, 1, 1, 5), None, None)]
    out = p.hourly_by_facility(spark.createDataFrame(rows, "facility string, ts timestamp_ntz, n double, w double"), ["n"], ["w"]).orderBy("facility").collect()
    assert [(r.facility, r.n, r.w, r.time, r.day_of_week) for r in out] == [("f", 1.0, 4.0, "05:00", 0), ("g", 0.0, None, "05:00", 0)]


def test_jitter_is_small_and_not_negative(spark):
    history = spark.range(200).select((F.col("id") % 12 + 1).alias("month"), (F.col("id") % 7).cast("double").alias("w"))
    spine = spines.month_spine(spark, "2025-01-01", "2030-12-01")
    assert spine.count() == 72
    future = p.attach_climatology(spine, history, ["w"])
    noisy = p.jitter(future, history, ["w"], F.col("month_start"))
    pair = noisy.select("month_start", F.col("w").alias("n")).join(future, "month_start")
    std = history.agg(F.stddev("w")).first()[0]
    assert pair.filter((F.abs(F.col("n") - F.col("w")) > 5 * 0.05 * std) | (F.col("n") < 0)).count() == 0
    assert pair.filter(F.col("n") != F.col("w")).count() == 72


def test_hour_spine(spark):
    assert spines.hour_spine(spark, datetime(2025, 1, 1), datetime(2030, 12, 31, 23)).count() == 52584
    assert spines.hour_spine(spark, datetime(2025, 1, 1, 5), datetime(2025, 1, 1, 7)).count() == 3


def test_names(spark):
    assert readers.clean_name(" Harbour Line/Bay & Co. ") == "harbour_line_bay_co"
    df = spark.createDataFrame([(float("nan"), 1)], "` a b ` double, c int")
    assert readers.missing_as_null(readers.trim_names(df)).first()[0] is None


def test_csv_files_keep_text_until_cast(spark):
    df = spark.createDataFrame([("1", "x,y"), (None, "z")], "a string, b string")
    path = sinks.write_all({"t": df}, scratch_path(spark, "csv"))["t"]
    back = readers.read_csv(spark, path, readers.text_schema(["a", "b"]))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_partitioned_table_is_pruned(spark):
    path = sinks.write_table(spark.range(100).withColumn("year", (F.col("id") % 4 + 2000).cast("int")), scratch_path(spark, "p"), partition_by=["year"])
    df = spark.read.parquet(path).filter("year = 2001")
    assert df.count() == 25
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().executedPlan().toString()


def test_one_hot_keeps_all_levels(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string").coalesce(1)
    assert [tuple(r)[1:] for r in p.one_hot(df, "c", {"a": "c_a", "b": "c_b"}).collect()] == [(1, 0), (0, 1), (0, 0)]
