"""Training-data queries against their SQL, and the shape of those without."""

import oracle
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from forecastops.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
BRUTE_FORCE = {"op2_decontaminate", "op5_divergence_rules", "op6_simhash", "op7_quality", "op8_toxicity", "op11_periodic_runs",
               "op12_winnowing", "op13_token_pairs"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_all_are_registered():
    assert set(QUERIES) - set(ORACLES) == BRUTE_FORCE
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", ["op5_divergence_rules", "op9_chat_format", "op12_winnowing"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow"):
        assert word not in plan


def test_no_query_forms_a_cross_join(spark):
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
