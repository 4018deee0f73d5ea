"""Queues of touched workspaces are synced, the others stay as they were."""

from __future__ import annotations

import datetime as dt

from hall import AS_OF, STAMP

from ledgerspark import schemas
from ledgerspark.operators import merges
from ledgerspark.plans import actions

FIRST, LATER = dt.datetime(2031, 11, 20, 8), dt.datetime(2031, 11, 20, 17)


def full(hall, stored, now, bills=None):
    bills = hall["obligations"] if bills is None else bills
    return actions.action_queue(hall["workspaces"], bills, hall["jobs"], stored, AS_OF, now)


def rows(frame) -> dict:
    return {(r.workspace_id, r.id): r for r in frame.collect()}


def test_only_touched_queues_change(spark, hall):
    before = spark.createDataFrame(full(hall, hall["actions"], FIRST).collect(), schemas.ACTIONS)
    changes = spark.createDataFrame(
        [("hall", "o5", "paid", None, None, LATER, 1), ("annex", "o6", "due", None, None, STAMP, 2)],
        schemas.STATUS_CHANGES,
    )
    after = merges.apply_obligation_changes(hall["obligations"], changes)
    touched = actions.touched_workspaces(FIRST, (changes, "ts"), (hall["jobs"], "confirmed_at"))
    assert [r.workspace_id for r in touched.collect()] == ["hall"]
    found = rows(
        actions.refreshed_queue(
            hall["workspaces"], after, hall["jobs"], before, touched, AS_OF, LATER
        )
    )
    everything = rows(full(hall, before, LATER, after))
    assert found.keys() == everything.keys() and ("hall", "draft-o5") not in found
    for key, row in everything.items():
        stamp = LATER if key[0] == "hall" else FIRST
        assert found[key].asDict() == row.asDict() | {"updated_at": stamp}


def test_nothing_touched_nothing_changed(spark, hall):
    before = spark.createDataFrame(full(hall, hall["actions"], FIRST).collect(), schemas.ACTIONS)
    for names in [[], [("stranger",), (None,)]]:
        touched = spark.createDataFrame(names, "workspace_id string")
        found = actions.refreshed_queue(
            hall["workspaces"], hall["obligations"], hall["jobs"], before, touched, AS_OF, LATER
        )
        assert rows(found) == rows(before)


def test_all_touched_equals_a_full_sync(spark, hall):
    touched = hall["workspaces"].select("workspace_id")
    found = actions.refreshed_queue(
        hall["workspaces"], hall["obligations"], hall["jobs"], hall["actions"],
        touched.unionByName(touched), AS_OF, LATER,
    )
    assert rows(found) == rows(full(hall, hall["actions"], LATER))
