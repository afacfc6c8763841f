"""Plan properties the scale review relies on, asserted on the physical plans."""

import pytest

import __spark_entry__ as ENTRY
from tests.conftest import SF_SMALL

# queries whose construction fits a model or writes files are checked elsewhere
FITTING = {"forest", "gbt", "tree", "isotonic", "importance_topk", "stream_score", "batch_score",
           "saved_score", "feature_vectors", "linreg_one", "metrics", "csv_roundtrip", "json_roundtrip", "batch_output", "lookup_csv"}


def plan(spark, name) -> str:
    return ENTRY.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ENTRY.queries()) - FITTING))
def test_no_python_evaluation(spark, name):
    text = plan(spark, name)
    assert not any(node in text for node in ("ArrowEvalPython", "BatchEvalPython", "PythonUDF", "MapInPandas"))


def test_equality_filter_reaches_the_scan(spark):
    text = plan(spark, "filter_eq_df")
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint," in text


def test_scans_read_only_needed_columns(spark):
    assert "ReadSchema: struct<o_totalprice:double>" in plan(spark, "dash_totals")
    frontier = plan(spark, "frontier_merge")
    assert "html" not in frontier                      # the page body never reaches the frontier update


def test_orders_are_aggregated_before_the_customer_join(spark):
    text = plan(spark, "dash_grid")
    join_at = text.find("Join")
    assert join_at > 0 and "partial_count" in text[join_at:]   # partial aggregate below the join
