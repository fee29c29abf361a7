import pytest
from pyspark.sql import functions as F

from forecastops.operators import joins as j


@pytest.mark.parametrize("how", ["inner", "left"])
def test_sums_without_joining_equal_sums_of_the_join(spark, how):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", 5), ("c", 7), (None, 9)], "k string, x bigint")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("b", None), ("d", 1), (None, 3)], "k string, y bigint")
    want = left.join(right, "k", how).groupBy("k").agg(F.count(F.lit(1)).alias("joined_rows"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    got = j.join_sums(left, right, ["k"], {"x": F.col("x")}, {"y": F.col("y")}, how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_right_chain_equals_left_join_of_inner_joins(spark):
    td = spark.createDataFrame([("2020", "01", "f"), ("2020", "02", "g")], "y string, m string, fac string")
    a = spark.createDataFrame([("2020", "01", 1), ("2020", "03", 2)], "y string, m string, a int")
    b = spark.createDataFrame([("2020", "01", 5), ("2020", "01", 6), ("2020", "02", 7)], "y string, m string, b int")
    p = spark.createDataFrame([("2020", "01", 8), ("2020", "02", 9), ("2021", "01", 10)], "y string, m string, p int")
    got = j.right_join_chain(td, [a, b, p], ["y", "m"]).select("fac", "a", "b", "p")
    inner = td.join(a, ["y", "m"]).join(b, ["y", "m"])
    want = p.join(inner, ["y", "m"], "left").select("fac", "a", "b", "p")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_broadcast_only_below_the_bound(spark):
    fact, side = spark.range(1000), spark.range(50).withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, kind in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
            joined = fact.join(j.small_side(side, bound), "id", "left")
            assert kind in joined._jdf.queryExecution().executedPlan().toString()
            assert joined.filter("v = 1").count() == 50
            assert fact.join(j.measured_side(side, bound), "id", "left").filter("v = 1").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_star_keeps_equal_names_apart(spark):
    fact = spark.createDataFrame([("2020-01-05", 1)], "d string, n int")
    dim = spark.createDataFrame([("2020-01", "r1", 2), ("2020-01", "r2", 3)], "d string, route string, n int")
    out = j.star_join(fact, F.substring("d", 1, 7), {"a_": (dim, F.col("d")), "b_": (dim, F.col("d"))})
    assert out.columns == ["d", "n", "a_d", "a_route", "a_n", "b_d", "b_route", "b_n"]
    assert out.count() == 4


def test_outer_merge_keeps_every_key(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, "y")], "k int, b string")
    assert sorted(map(tuple, j.merge_outer([a, b], ["k"]).collect())) == [(1, "x", None), (2, None, "y")]


def test_month_joins_without_a_broadcast_are_salted_and_equal(spark, monkeypatch):
    import oracle

    from forecastops.catalog import ORACLES, QUERIES
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(j, "is_small", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("report_q02", "report_q07", "report_q08", "report_q09", "join_month_text", "join_star_month", "join_right_chain"):
            df = QUERIES[name](spark, d)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "__salt" in plan and "BroadcastHashJoin" not in plan
            assert oracle.differences(df, oracle.connect(d), ORACLES[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_means_rows_and_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000, [1, 2])] * 50, "a string, b array<int>")
    assert j.is_small(wide) and not j.is_small(wide, max_rows=49) and not j.is_small(wide, max_bytes=40_000)
