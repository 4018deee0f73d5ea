"""Figures of the climbing hall's ledgers, worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from hall import AS_OF, d
from pyspark.sql import functions as F

from ledgerspark import schemas
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import ranking
from ledgerspark.operators.documents import index_chunks
from ledgerspark.plans import actions, brief, dashboard, forecast, investigate, ledger

NOW = dt.datetime(2031, 11, 20, 7, 30)


def facts(hall, as_of=AS_OF):
    return dashboard.workspace_facts(
        hall["workspaces"], hall["sales"], hall["expenses"], hall["obligations"], hall["products"], as_of
    )


def queue(hall):
    return actions.action_queue(
        hall["workspaces"], hall["obligations"], hall["jobs"], hall["actions"], AS_OF, NOW
    )


def base(hall):
    return forecast.forecast_base(
        hall["workspaces"], hall["sales"], hall["purchases"], hall["expenses"], hall["obligations"]
    )


def test_stat_cards(hall):
    rows = dashboard.dashboard_stats(facts(hall)).orderBy("workspace_id", "ord").collect()
    cards = {w: [(r.value, r.tone) for r in rows if r.workspace_id == w] for w in ("hall", "annex", "quiet")}
    assert cards["hall"] == [
        ("₹3.3K", "positive"), ("53.8%", "positive"), ("₹7.9K", "critical"), ("₹290", "warning"),
    ]
    assert cards["annex"] == [
        ("₹8", "positive"), ("0.0%", "warning"), ("₹100", "critical"), ("₹0", "neutral"),
    ]
    assert cards["quiet"] == [
        ("₹0", "neutral"), ("0.0%", "warning"), ("₹0", "neutral"), ("₹0", "neutral"),
    ]
    delta = {r.workspace_id: r.delta for r in rows if r.ord == 3}
    assert delta["hall"] == "Hall lease, Holds order, Electricity"
    assert delta["quiet"] == "No recurring bills due soon"


def test_month_series(hall):
    rows = A.margin_series(hall["sales"].filter("workspace_id = 'hall'")).collect()
    found = {r.month_label: (float(r.revenue_inr), round(r.margin_pct, 4)) for r in rows}
    assert found == {"Sep": (720.0, 64.5), "Oct": (864.4, 51.25), "Nov": (1756.8, 52.68)}


def test_months_of_different_years_share_a_row(spark):
    rows = [("w", "1", d("2029-02-11"), "a", None, None, 1, 10, None, None),
            ("w", "2", d("2030-02-03"), "a", None, None, 1, 5, None, None)]
    sales = spark.createDataFrame(
        rows,
        "workspace_id string, id string, date date, sku string, name string, category string,"
        "quantity int, amount_inr int, margin_pct int, created_at timestamp",
    )
    assert A.margin_series(sales).count() == 1
    assert A.margin_series(sales, by_year=True).count() == 2
    assert A.margin_series(sales).first().margin_pct is None


def test_near_expiry_moves_with_the_day(hall):
    (row,) = A.expiry_exposure(hall["products"], AS_OF).collect()
    assert (row.lot_count, float(row.exposure)) == (2, 290.0)
    (later,) = A.expiry_exposure(hall["products"], d("2031-11-21")).collect()
    assert (later.lot_count, float(later.exposure)) == (3, 416.0)
    assert A.near_expiry(hall["products"], d("2031-09-16")).count() == 0
    alerts = dashboard.inventory_alerts(hall["workspaces"], hall["products"], AS_OF)
    assert {(r.workspace_id, r.id) for r in alerts.collect()} == {
        ("hall", "expiry-BAR"), ("hall", "cash-watch"), ("annex", "cash-watch"), ("quiet", "cash-watch"),
    }


def test_candidate_actions(hall):
    found = {r.id: r for r in queue(hall).collect()}
    assert {(r.workspace_id, k, r.severity) for k, r in found.items()} == {
        ("hall", "draft-o5", "critical"),
        ("hall", "obligation-o0", "critical"),
        ("hall", "draft-o2", "warning"),
        ("annex", "obligation-o6", "critical"),
        ("quiet", "watch-stock", "info"),
    }
    assert found["obligation-o0"].detail == (
        "₹2,400 is due in 2 days and should stay visible in the owner plan."
    )
    assert "in 0 days" in found["obligation-o6"].detail


def test_rankings(hall):
    mine = hall["sales"].filter("workspace_id = 'hall'")
    skus = A.top_skus(mine).orderBy("ord").collect()
    assert [(r.sku, float(r.revenue)) for r in skus] == [
        ("DAYPASS", 1350.0), ("CARD10", 900.0), ("CHALK", 477.6),
    ]
    groups = A.top_categories(hall["expenses"]).orderBy("ord").collect()
    assert [(r.category, int(r.expense_total)) for r in groups] == [
        ("Premises", 7200), ("Gear", 5040), ("Staff", 540),
    ]
    row = facts(hall).filter("workspace_id = 'hall'").first()
    assert (row.utility_avg, row.top_supplier_due, row.recurring_due) == (260.0, 5200.0, 10720.0)


@pytest.mark.parametrize(
    ("metric", "horizon", "low", "high"),
    [
        ("sales", "30d", 492.79, 555.69),
        ("SALES", "120d", 492.79, 539.97),
        ("purchases", "14d", 924.0, 1134.0),
        ("recurring", "30d", 10184.0, 11792.0),
        ("cash", "30d", -1814.13, -2607.81),
        ("tides", "200d", 492.79, 539.97),
    ],
)
def test_forecast(spark, hall, metric, horizon, low, high):
    asked = spark.createDataFrame(
        [("hall", "r", metric, horizon)],
        "workspace_id string, request_id string, metric string, horizon string",
    )
    (row,) = forecast.forecast(asked, base(hall)).collect()
    assert (round(row.low, 2), round(row.high, 2)) == (low, high)
    if metric == "cash":
        assert row.projected_range == "₹-1,814 to ₹-2,608 per day"
    if metric == "recurring":
        assert row.projected_range == "₹10.2K to ₹11.8K in next 30 days"


def test_scenario(spark, hall):
    asked = spark.createDataFrame(
        [("hall", "a", "delayed_reorder", 30, 7.5), ("hall", "b", "flood", 30, 101.0)],
        "workspace_id string, request_id string, scenario_type string, horizon_days int,"
        "percentage double",
    )
    valid = forecast.valid_scenarios(asked)
    assert [r.request_id for r in valid.collect()] == ["a"]
    first, second = forecast.scenario_deltas(valid, base(hall)).orderBy("ord").collect()
    assert first.baseline == "Current daily cash delta baseline: ₹-2,268"
    assert first.projected == "Improves by ~7.5% temporarily"
    assert second.metric == "Stockout probability"


def test_brief_and_run_log(hall):
    alerts = dashboard.inventory_alerts(hall["workspaces"], hall["products"], AS_OF)
    lines = brief.owner_brief(
        hall["workspaces"],
        dashboard.dashboard_stats(facts(hall)),
        alerts,
        hall["obligations"],
        queue(hall),
        d("2031-11-22"),
    ).collect()
    texts = {(r.workspace_id, r.section, r.sort_key): r.text for r in lines}
    assert texts["hall", "items", "3"] == "Bills due soon: ₹7.9K"
    due = sorted((r.sort_key, r.text) for r in lines if (r.workspace_id, r.section) == ("hall", "due_today"))
    assert [text for _, text in due] == ["Rope order — ₹1,800", "Hall lease — ₹2,400"]
    assert texts["hall", "anomalies", "1"] == "Energy bar needs expiry attention"
    assert texts["annex", "anomalies", ""].startswith("No major anomalies")
    assert texts["hall", "suggested", "1"] == "Stage supplier follow-up for Holds order"
    assert texts["hall", "suggested", "2"] == "Stage supplier follow-up for Rope order"
    log = brief.run_log(hall["workspaces"], alerts, hall["obligations"], d("2031-11-24")).collect()
    assert {(r.workspace_id, r.anomaly_count, r.due_reminder_count) for r in log} == {
        ("hall", 1, 3), ("annex", 1, 1), ("quiet", 1, 1),
    }


def test_drafts(spark, hall):
    asked = spark.createDataFrame(
        [("hall", "1", "obligation-o0"), ("hall", "2", "none"), ("quiet", "3", "none")],
        "workspace_id string, request_id string, action_id string",
    )
    rows = {r.request_id: r for r in actions.action_drafts(asked, queue(hall)).collect()}
    assert rows["1"].draft_text.startswith("Review Hall lease today")
    assert (rows["2"].target_entity, rows["2"].approval_required) == ("Holds order", True)
    assert (rows["3"].action_type, rows["3"].approval_required) == ("review_import", False)


def test_collection_summaries(hall):
    names = {"recurring_obligations": "obligations"}
    kinds = ["sales", "purchases", "products", "expenses", "recurring_obligations"]
    collections = {kind: hall[names.get(kind, kind)] for kind in kinds}
    rows = ledger.collection_summaries(hall["workspaces"], collections, hall["jobs"]).collect()
    found = {(r.workspace_id, r.import_type): r for r in rows}
    assert len(found) == 15
    assert found["quiet", "sales"].row_count == 0 and found["hall", "sales"].row_count == 9
    sample = found["hall", "sales"].sample_rows
    assert [r[0] for r in sample] == ["2031-11-03", "2031-11-20", "2031-11-28"]
    assert found["hall", "sales"].latest_import_at is None


def test_obligations_are_listed_in_order(hall):
    rows = ranking.listing(hall["obligations"], "obligations").collect()
    assert [r.id for r in rows] == ["o6", "o5", "o0", "o3", "o2", "o1", "o4"]


def test_investigation(spark, hall):
    documents = spark.createDataFrame(
        [
            ("hall", "d1", "Wall holds", "delivery", "Sixty boxes of holds arrived by barge",
             d("2031-10-25"), NOW),
            ("hall", "d2", "Heating letter", "notice", "The boiler runs all night in the cold loft",
             d("2031-11-06"), NOW),
        ],
        schemas.DOCUMENTS,
    )
    questions = spark.createDataFrame(
        [
            ("hall", "q1", "Why did profit drop this month?"),
            ("hall", "q2", "What are my top selling products?"),
            ("hall", "q3", "why does the boiler run all night"),
            ("annex", "q4", "why is the annex so quiet"),
        ],
        "workspace_id string, question_id string, question string",
    )
    settings = spark.createDataFrame(
        [("hall", "hybrid", ["one", "two"], NOW), ("annex", "local-open", [], NOW)], schemas.PROVIDER_SETTINGS
    )
    result = investigate.investigate(
        questions,
        facts(hall),
        investigate.insight_texts(hall["workspaces"], hall["sales"], hall["expenses"]),
        settings.drop("updated_at"),
        index_chunks(documents),
        documents,
    )
    rows = {r.question_id: r for r in result.collect()}
    assert rows["q1"].refused and rows["q1"].confidence == 0.98 and len(rows["q1"].evidence) == 1
    assert rows["q2"].evidence[3].detail == (
        "Top selling SKUs by revenue are DAYPASS (₹1.4K), CARD10 (₹900), CHALK (₹478)."
    )
    assert rows["q2"].confidence == 0.89 and rows["q2"].provider == "ollama-local"
    assert rows["q3"].provider == "one" and rows["q3"].estimated_cost_usd > 0
    assert rows["q3"].evidence[3].source == "Heating letter"
    assert rows["q3"].summary.endswith("tracked revenue is ₹3.3K.")
    assert rows["q4"].summary.startswith("Profit pressure is elevated")
    kept = investigate.classify(questions, "statement").filter(F.col("refused")).count()
    assert kept == 0


def test_positions_do_not_depend_on_the_size_of_a_day(spark):
    rows = spark.range(300).selectExpr(
        "concat('w', id % 2) workspace_id", "concat('a', id) id", "if(id % 3 = 0, 'open', 'snoozed') status",
        "timestamp'2031-01-01 10:00:00' + make_interval(0, 0, 0, 0, 0, id % 4) updated_at",
    )
    whole, ranges = (ranking.with_position(rows, "actions", block_rows=n).collect() for n in (None, 10))
    assert sorted(whole) == sorted(ranges)
    places = sorted((r.workspace_id, r.position) for r in ranges)
    assert places == [(w, n) for w in ("w0", "w1") for n in range(150)]
