"""Every named query against its SQL on the smallest tables, and what plans must not hold."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
FOLDER = "/root/testdata/sf0.001"

import compare  # noqa: E402

from faultline.plans import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare.compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# queries that run Python on Arrow batches, and why
PYTHON = {"similar_incidents", "similar_incidents_lsh", "lsh_recall", "ivf_recall", "retrieval_context", "rag_evaluate", "retrieval_outcome",
          "neighbour_action_profile", "similar_by_codes", "full_comparisons", "cooldown_alerts", "claim_actions"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_") or n == "stream_status"))
def test_plan_has_no_cross_join_and_no_row_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    if name not in PYTHON:
        assert "InPandas" not in plan and "ArrowEvalPython" not in plan
