"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerspark.catalog import oracle
from ledgerspark.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SOME = [
    "a1_mixed_layouts", "a4_staged_rows", "b3_import_preview", "b4_coerced_purchases", "b12_routed_insights",
    "b13_masked_documents", "c2_load_expenses", "c3_upserted_products", "c4_upserted_documents",
    "c6_refreshed_actions", "c6_synced_actions", "c9_members_after_changes", "c10_blocked_chunks", "c10_nearest_chunks", "c12_action_statuses",
    "c13_applied_rows", "d1_margin_series_by_year", "e1_moving_average_series", "e2_latest_rows",
    "f7_import_history", "g1_idle_workspaces", "h8_chunk_vectors", "k4_collection_summaries",
    "k6_action_drafts", "d7_kept_after_changes", "k4_kept_summaries", "k7_kept_brief", "k7_owner_brief", "k8_forecast", "k9_scenario_deltas", "k10_evidence",
]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
    return connection


def test_every_query_has_its_sql():
    assert set(oracle.QUERIES) == set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    frame = QUERIES[name](spark, SF)
    cursor = tables.execute(oracle.all_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    at = [frame.columns.index(c) for c in columns]
    found = sorted(repr([row[i] for i in at]) for row in frame.collect())
    assert found == sorted(repr(list(row)) for row in cursor.fetchall())
