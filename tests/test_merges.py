"""Loads and merges on small tables."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from hall import STAMP, d

from ledgerspark import schemas
from ledgerspark.operators import access, merges

NOW = dt.datetime(2026, 5, 9, 8)
T1, T2 = dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 2)


def test_idempotent_load(spark):
    def sale(i, sku, amount, name=None):
        return ("w", i, d("2026-05-01"), sku, name, None, 1, Decimal(amount), None, STAMP)

    stored = spark.createDataFrame([sale("0", "a", "1"), sale("00", "a", "1")], schemas.SALES)
    batch = spark.createDataFrame(
        [sale("1", "a", "1"), sale("3", "b", "1", "late"), sale("2", "b", "1", "first")], schemas.SALES
    )
    key = schemas.LEDGERS["sales"]["key"]
    fresh = merges.idempotent_load(stored, batch, key, ["id"])
    assert [(r.id, r.name) for r in fresh.collect()] == [("2", "first")]
    assert merges.idempotent_load(stored.unionByName(fresh), batch, key, ["id"]).count() == 0


def test_product_upsert(spark):
    def product(sku, name, expires, n=None):
        row = ("w", sku, name, "c", Decimal(1), 1, expires, STAMP)
        return row if n is None else (*row, n)

    stored = spark.createDataFrame(
        [product("a", "old", d("2026-01-01")), product("z", "kept", None)], schemas.PRODUCTS
    )
    batch = spark.createDataFrame(
        [product("a", "x", d("2026-02-02"), 1), product("a", "y", None, 2), product(" ", "n", None, 3),
         product("b", "new", None, 4)],
        "workspace_id string, sku string, name string, category string, unit_price_inr decimal(12,2),"
        "quantity_on_hand int, expires_on date, created_at timestamp, n int",
    )
    found = {r.sku: r for r in merges.upsert_products(stored, batch, ["n"]).collect()}
    assert {k: (r.name, r.expires_on) for k, r in found.items()} == {
        "a": ("y", None), "z": ("kept", None), "b": ("new", None),
    }


def actions(spark, *rows):
    return spark.createDataFrame(
        [(ws, i, "t", "d", "info", "k", "e", s, None, None, T1, T1) for ws, i, s in rows],
        schemas.ACTIONS,
    )


def test_action_sync(spark):
    stored = actions(
        spark, ("w", "gone", "open"), ("w", "kept", "snoozed"), ("w", "same", "resolved"),
        ("quiet", "gone", "open"),
    )
    candidates = spark.createDataFrame(
        [("w", i, "new", "d", "warning", "k", "e", "open") for i in ("same", "fresh")],
        "workspace_id string, id string, title string, detail string, severity string,"
        "action_type string, target_entity string, status string",
    )
    synced = merges.sync_actions(stored, candidates, NOW)
    found = {(r.workspace_id, r.id): r for r in synced.collect()}
    assert {k: (r.title, r.status) for k, r in found.items()} == {
        ("w", "kept"): ("t", "snoozed"),
        ("w", "same"): ("new", "resolved"),
        ("w", "fresh"): ("new", "open"),
        ("quiet", "gone"): ("t", "open"),
    }
    assert found["w", "same"].created_at == T1 and found["w", "same"].updated_at == NOW
    again = merges.sync_actions(synced, candidates, NOW)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, synced.collect()))


def changes(spark, *rows):
    return spark.createDataFrame(
        [("w", e, s, "2026-06-01", "done", t, n) for n, (e, s, t) in enumerate(rows)],
        schemas.STATUS_CHANGES,
    )


def test_action_changes(spark):
    log = changes(
        spark, ("a", "resolved", T1), ("a", " Snoozed", T2), ("b", "Resolved ", T1), ("x", "odd", T1)
    )
    stored = actions(spark, ("w", "a", "open"), ("w", "b", "open"), ("w", "c", "open"))
    found = {r.id: r for r in merges.apply_action_changes(stored, log).collect()}
    assert (found["a"].status, found["a"].snoozed_until, found["a"].resolution_note) == (
        "snoozed", "2026-06-01", None,
    )
    assert (found["b"].status, found["b"].snoozed_until, found["b"].resolution_note) == (
        "resolved", None, "done",
    )
    assert found["c"].status == "open" and found["c"].updated_at == T1
    assert (found["x"].title, found["x"].status) == ("Manual action entry", "watching")


def test_obligation_changes(spark, hall):
    log = changes(spark, ("o0", "paid", T1), ("o1", "PAID", T1), ("nobody", "paid", T1))
    bills = hall["obligations"].replace("hall", "w", "workspace_id")
    found = {r.id: r.status for r in merges.apply_obligation_changes(bills, log).collect()}
    assert found == {
        "o0": "paid", "o1": "scheduled", "o2": "scheduled", "o3": "due", "o4": "paid", "o5": "due", "o6": "due"
    }
    assert [r.entity_id for r in merges.unknown_changes(bills, log).collect()] == ["nobody"]


def test_settings(spark):
    saved = spark.createDataFrame(
        [("a", "odd", [" X ", "x", "", "Y"], T1), ("a", "hybrid", None, T2)], schemas.PROVIDER_SETTINGS
    )
    none = spark.createDataFrame([], schemas.PROVIDER_SETTINGS)
    (row,) = merges.upsert_settings(none, saved).collect()
    assert (row.mode, row.providers) == ("hybrid", [])
    every = spark.createDataFrame([("a",), ("b",)], "workspace_id string")
    older = merges.upsert_settings(none, saved.filter("mode = 'odd'"))
    found = {r.workspace_id: (r.mode, r.providers) for r in merges.settings_for(every, older).collect()}
    assert found == {"a": ("local-open", ["x", "y"]), "b": ("local-open", [])}


def members(spark, *rows):
    return spark.createDataFrame([(ws, u, r, T1) for ws, u, r in rows], schemas.MEMBERS)


def test_visible_members(spark):
    people = members(
        spark, ("a", "1", "owner"), ("a", "2", "guest"), ("b", "1", "accountant"), ("c", "3", "manager")
    )
    asked = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("c", "9")], "workspace_id string, requester_id string"
    )
    found = {(r.workspace_id, r.user_id): r.role for r in access.visible_members(people, asked).collect()}
    assert found == {("a", "1"): "owner", ("a", "2"): "accountant"}


def test_role_changes(spark):
    people = members(spark, ("a", "1", "owner"), ("a", "2", "manager"), ("a", "3", "accountant"))
    asked = spark.createDataFrame(
        [
            (1, "a", "1", "3", "manager"), (2, "a", "1", "3", "owner"), (3, "a", "2", "3", "owner"),
            (4, "a", "1", "1", "manager"), (5, "a", "1", "2", "boss"), (6, "a", "1", "9", "owner"),
        ],
        "change_id int, workspace_id string, requester_id string, user_id string, role string",
    )
    judged = access.judge_role_changes(people, asked)
    assert [r.outcome for r in judged.orderBy("change_id").collect()] == [
        "applied", "applied", "not_owner", "self_demotion", "invalid_role", "member_not_found",
    ]
    after = {r.user_id: r.role for r in access.apply_role_changes(people, judged).collect()}
    assert after == {"1": "owner", "2": "manager", "3": "owner"}


def test_new_obligations(spark):
    asked = spark.createDataFrame(
        [("w", " Rent ", "Facility\t", 10.005, "weekly", None), ("w", "b", "c", 1.0, "annual", "odd")],
        "workspace_id string, label string, category string, amount_inr double, recurrence string,"
        "status string",
    )
    first, second = merges.new_obligations(asked).collect()
    assert (first.label, first.category, first.recurrence, first.status) == (
        "Rent", "Facility", "monthly", "due",
    )
    assert (second.recurrence, second.status) == ("annual", "scheduled")


def judged_by_hand(people: dict, asked: list) -> list:
    """Requests of one workspace, one after the other."""
    roles, out = dict(people), []
    for number, by, whom, role in sorted(asked):
        if roles.get(by) != "owner":
            outcome = "not_owner"
        elif role not in ("owner", "manager", "accountant"):
            outcome = "invalid_role"
        elif by == whom and role != "owner":
            outcome = "self_demotion"
        elif whom not in roles:
            outcome = "member_not_found"
        else:
            outcome = "applied"
            roles[whom] = role
        out.append((number, outcome))
    return out


ASKED = "change_id int, workspace_id string, requester_id string, user_id string, role string"


def test_a_chain_of_demotions(spark):
    # each owner is demoted by the one before, so only every other change counts
    people = {str(i): "owner" for i in range(6)}
    asked = [(9 - i, str(i), str(i + 1), "manager") for i in range(5)] + [(1, "5", "0", "accountant")]
    given = [(n, "w", *rest) for n, *rest in asked]
    judged = access.judge_in_order(
        members(spark, *[("w", u, r) for u, r in people.items()]), spark.createDataFrame(given, ASKED)
    )
    assert sorted((r.change_id, r.outcome) for r in judged.collect()) == judged_by_hand(people, asked)


def test_many_changes_in_order(spark):
    draw = random.Random(3)
    people = {w: {str(i): draw.choice(["owner", "manager", "guest"]) for i in range(7)} for w in "ab"}
    people["b"]["0"] = "owner"
    asked = {
        w: [
            (n, str(draw.randrange(8)), str(draw.randrange(8)), draw.choice(["owner", "manager", "boss"]))
            for n in range(60)
        ]
        for w in "ab"
    }
    given = [(n, w, *rest) for w in "ab" for n, *rest in asked[w]]
    rows = members(spark, *[(w, u, r) for w in "ab" for u, r in people[w].items()])
    # blocks of ten changes, so that what one block ends with is carried into the next
    judged = access.judge_in_order(rows, spark.createDataFrame(given, ASKED), rows_per_block=10).collect()
    for w in "ab":
        found = sorted((r.change_id, r.outcome) for r in judged if r.workspace_id == w)
        assert found == judged_by_hand(people[w], asked[w])


def test_no_role_changes(spark):
    none = spark.createDataFrame([], ASKED)
    assert access.judge_in_order(members(spark, ("a", "1", "owner")), none).count() == 0
