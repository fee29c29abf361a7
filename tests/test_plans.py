"""Shapes of physical plans: what must not appear in any registered query."""

import re

import pytest

from forecastops.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Global aggregates, and windows over a table whose size the calendar, the slices or the classes bound.
ONE_TASK = {"spine_monthly", "spine_hourly", "grid_future", "scan_roles", "join_climatology", "impute_linear", "impute_median_mean",
            "agg_range_counts", "label_high_traffic", "seg_standardise", "eval_class_report", "fc_weather_jitter", "lr_normal_equations",
            "fc_hourly_lr", "fc_series_gbt", "fc_history_union", "split_random", "lr_category_effects", "seg_kmeans_series", "seg_traffic_level", "clf_random_forest", "limit_topn",
            "split_stratified"}
FITS = {n for n in QUERIES if n.startswith(("fc_series", "fc_hist", "fc_fac", "fc_hourly", "lr_", "cv_grid", "clf_"))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("EvalPython|MapInPandas|MapInArrow|FlatMapGroups", plan)
    if name not in ONE_TASK:
        assert "Exchange SinglePartition" not in plan


def test_scans_read_needed_columns_only(spark):
    plan = QUERIES["agg_trycast_sum"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
    assert "EqualTo(o_orderstatus,O)" in plan


def test_first_of_month_limits_before_the_shuffle(spark):
    plan = QUERIES["win_first_of_month"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_splits_and_fences_do_not_shuffle_the_rows(spark):
    # The stand-in table behind filter_iqr and split_chrono is itself one aggregate, hence one exchange.
    for name, exchanges in {"split_stratified": 0, "split_chrono": 1, "filter_iqr": 1}.items():
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == exchanges, name
