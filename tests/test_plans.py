"""Shape of the plans: pruned scans, limits before shuffles, no pairs of rows."""

from __future__ import annotations

import os

import pytest

from ledgerspark.catalog.queries import QUERIES
from ledgerspark.catalog.views import Views
from ledgerspark.operators import aggregates as A

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    shown = plan(A.margin_series(Views(spark, SF).sales()))
    assert "p_name" not in shown and "l_tax" in shown and "l_linestatus" not in shown


def test_filters_reach_the_scan(spark):
    shown = plan(A.near_expiry(Views(spark, SF).products(), "1998-06-15").filter("quantity_on_hand > 40"))
    assert "GreaterThan(p_size,40)" in shown


@pytest.mark.parametrize("name", ["f3_top_skus", "e2_latest_rows", "e3_soonest_due", "c2_load_sales"])
def test_top_k_limits_before_the_shuffle(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in shown and "Partial" in shown


@pytest.mark.parametrize(
    "name",
    ["k1_dashboard_stats", "k6_action_drafts", "k8_forecast", "c9_judged_role_changes",
     "c6_synced_actions", "b13_masked_documents", "k4_collection_summaries"],
)
def test_no_nested_loops_and_no_row_functions(spark, name):
    shown = plan(QUERIES[name](spark, SF))
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]:
        assert bad not in shown


@pytest.mark.parametrize(
    ("name", "most"),
    [("k7_owner_brief", 24), ("k6_action_drafts", 20), ("c6_synced_actions", 9), ("k1_dashboard_stats", 8)],
)
def test_reports_read_their_ledgers_a_few_times(spark, name, most):
    found = QUERIES[name](spark, SF)
    shown = found._jdf.queryExecution().sparkPlan().toString()
    assert shown.count("FileScan parquet") <= most
