"""Reports from kept figures equal those from the ledgers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from hall import AS_OF, BILLS, d
from pyspark.sql import functions as F

from ledgerspark import schemas
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import merges
from ledgerspark.plans import actions, brief, dashboard, kept, ledger

COLLECTIONS = ["sales", "purchases", "products", "expenses", "recurring_obligations"]


def collections(hall) -> dict:
    return {name: hall["obligations" if name == "recurring_obligations" else name] for name in COLLECTIONS}


@pytest.fixture(scope="module")
def root(hall, tmp_path_factory) -> str:
    """All ledgers kept; sales in two batches, the first of them written twice."""
    root = str(tmp_path_factory.mktemp("kept"))
    late = F.col("date") >= F.lit(d("2031-11-03"))
    for name, rows in collections(hall).items():
        if name == "sales":
            for batch, part in [("a", ~late), ("b", late), ("a", ~late)]:
                kept.keep_batch(rows.filter(part), name, root, batch)
        elif name in ("products", "recurring_obligations"):
            kept.keep_state(rows, name, root)
        else:
            kept.keep_batch(rows, name, root, "all")
    return root


def same(found, expected) -> bool:
    columns = expected.columns
    return sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, expected.collect()))


def figures(spark, hall, root, as_of):
    bills = kept.read_leads(spark, root, "recurring_obligations")
    return dashboard.with_defaults(
        kept.figures(hall["workspaces"], kept.read_sums(spark, root), bills, as_of)
    )


def facts(hall, as_of, **other):
    of = {**hall, **other}
    names = ["workspaces", "sales", "expenses", "obligations", "products"]
    return dashboard.workspace_facts(*[of[n] for n in names], as_of)


@pytest.mark.parametrize("days", [-400, -5, 0, 4, 11, 46])
def test_figures_of_any_day(spark, hall, root, days):
    as_of = AS_OF + dt.timedelta(days=days)
    assert same(figures(spark, hall, root, as_of), facts(hall, as_of))


@pytest.mark.parametrize("by_year", [False, True])
def test_margin_series(spark, hall, root, by_year):
    assert same(
        kept.margin_series(kept.read_sums(spark, root), by_year), A.margin_series(hall["sales"], by_year)
    )


def test_summaries(spark, hall, root):
    leads = {name: kept.read_leads(spark, root, name) for name in COLLECTIONS}
    counts = kept.row_counts(kept.read_sums(spark, root))
    found = ledger.collection_summaries(hall["workspaces"], leads, hall["jobs"], counts)
    assert same(found, ledger.collection_summaries(hall["workspaces"], collections(hall), hall["jobs"]))


def test_alerts_and_candidates(spark, hall, root):
    products = kept.read_leads(spark, root, "products")
    bills = kept.read_leads(spark, root, "recurring_obligations")
    spaces = hall["workspaces"]
    for days in [-30, 0, 9]:
        as_of = AS_OF + dt.timedelta(days=days)
        assert same(
            dashboard.inventory_alerts(spaces, products, as_of),
            dashboard.inventory_alerts(spaces, hall["products"], as_of),
        )
        assert same(
            actions.candidate_actions(spaces, bills, hall["jobs"], as_of),
            actions.candidate_actions(spaces, hall["obligations"], hall["jobs"], as_of),
        )


def test_many_bills_of_one_day_leave_three(spark):
    day, stamp = d("2031-12-01"), dt.datetime(2031, 1, 1)
    rows = [
        ("w", f"b{i:03}", f"label {i:03}", "Supplier" if i % 2 else "Facility",
         None if i == 7 else Decimal(i), day, "monthly", ["due", "scheduled", "paid"][i % 3], stamp)
        for i in range(200)
    ]
    bills = spark.createDataFrame(rows, schemas.OBLIGATIONS)
    leads = kept.lead_rows(bills, "recurring_obligations")
    assert leads.count() <= 6
    for as_of in [d("2031-11-25"), d("2031-12-20")]:
        assert same(A.soonest_due(leads, as_of), A.soonest_due(bills, as_of))
        assert same(A.first_labels(leads, as_of), A.first_labels(bills, as_of))


def test_changes_rewrite_the_touched_blocks_only(spark, hall, tmp_path):
    root = str(tmp_path / "kept")
    for name in ["sales", "expenses"]:
        kept.keep_batch(collections(hall)[name], name, root, "all")
    for name in ["products", "recurring_obligations"]:
        kept.keep_state(collections(hall)[name], name, root)
    before = {p.parent.name: p.name for p in (tmp_path / "kept/sums").rglob("*.parquet")}
    changes = spark.createDataFrame(
        [("hall", b[1], "paid", None, None, dt.datetime(2031, 11, 20), 1) for b in BILLS[:3]],
        schemas.STATUS_CHANGES,
    )
    after = merges.apply_obligation_changes(hall["obligations"], changes)
    kept.keep_state(after, "recurring_obligations", root, touched=changes)
    assert same(figures(spark, hall, root, AS_OF), facts(hall, AS_OF, obligations=after))
    now = {p.parent.name: p.name for p in (tmp_path / "kept/sums").rglob("*.parquet")}
    rewritten = [block for block in now if now[block] != before[block]]
    assert set(now) == set(before) and len(rewritten) == 1 and "recurring_obligations" in rewritten[0]


def test_nothing_kept_and_empty_ledgers(spark, hall, tmp_path):
    empty = {n: hall[n].limit(0) for n in ["sales", "expenses", "obligations", "products"]}
    expected = facts(hall, AS_OF, **empty)
    assert same(figures(spark, hall, str(tmp_path / "none"), AS_OF), expected)
    root = str(tmp_path / "empty")
    kept.keep_batch(empty["sales"], "sales", root, "a")
    kept.keep_state(empty["products"], "products", root)
    assert same(figures(spark, hall, root, AS_OF), expected)


def test_a_brief_reads_no_ledger_but_the_bills_due(spark, hall, root, tmp_path):
    stored = {}
    for name in ["workspaces", "obligations", "jobs", "actions"]:
        hall[name].write.parquet(str(tmp_path / name))
        stored[name] = spark.read.schema(hall[name].schema).parquet(str(tmp_path / name))
    spaces = stored["workspaces"]
    bills = kept.read_leads(spark, root, "recurring_obligations")
    products = kept.read_leads(spark, root, "products")
    found = brief.owner_brief(
        spaces,
        dashboard.dashboard_stats(figures(spark, {**hall, "workspaces": spaces}, root, AS_OF)),
        dashboard.inventory_alerts(spaces, products, AS_OF),
        stored["obligations"],
        actions.action_queue(spaces, bills, stored["jobs"], stored["actions"], AS_OF, AS_OF),
        AS_OF,
    )
    plan = found._jdf.queryExecution().sparkPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    # planned twice: the lines themselves, and which workspaces have none
    assert sum("/obligations" in line for line in scans) <= 2
    assert len(scans) <= 18
