"""Streaming jobs, run to the end of small file sources."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from hall import d

from ledgerspark import schemas
from ledgerspark.operators import merges
from ledgerspark.sources.tables import VersionedTable, append_batch, read_facts
from ledgerspark.streaming import jobs


def expense(i, day, label, amount):
    stamp = dt.datetime.fromisoformat(f"{day}T10:00:00")
    return ("w", i, d(day), label, "c", Decimal(amount), stamp)


def source(spark, path, schema, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{n}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")
    )


def test_entries_are_split(spark, tmp_path):
    stream = source(
        spark, str(tmp_path / "in"), schemas.EXPENSES,
        [expense("1", "2026-05-01", "a", "5"), expense("2", "2026-05-01", "b", "-5")],
        [expense("3", "2026-05-02", "a", "5")],
    )
    ledger, rejects = str(tmp_path / "ledger"), str(tmp_path / "rejects")
    jobs.ingest_entries(stream, "expenses", ledger, rejects, str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in spark.read.parquet(ledger).collect()} == {"1", "3"}
    assert [tuple(r.reasons) for r in spark.read.parquet(rejects).collect()] == [("negative_amount",)]


def test_each_key_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    old = [expense("0", "2026-05-01", "old", "1")]
    append_batch(spark.createDataFrame(old, schemas.EXPENSES), ledger, "before")
    stream = source(
        spark, str(tmp_path / "in"), schemas.EXPENSES,
        [expense("1", "2026-05-01", "old", "1"), expense("3", "2026-05-01", "x", "1"),
         expense("2", "2026-05-01", "x", "1")],
        [expense("4", "2026-05-01", "x", "1"), expense("5", "2026-05-01", "x", "2")],
    )
    jobs.ingest_once(
        stream, "expenses", ["created_at", "id"], ledger, str(tmp_path / "cp"), schemas.EXPENSES,
    ).awaitTermination()
    rows = read_facts(spark, ledger, schemas.EXPENSES)
    assert sorted(r.id for r in rows.collect()) == ["0", "2", "5"]


def test_late_keys_are_taken(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    days = ["2026-05-01", "2026-05-20", "2026-05-21", "2026-05-02", "2026-05-01"]
    stream = source(
        spark, str(tmp_path / "in"), schemas.EXPENSES,
        *[[expense(str(n), day, "x", "1")] for n, day in enumerate(days)],
    )
    jobs.ingest_once(
        stream, "expenses", ["created_at", "id"], ledger, str(tmp_path / "cp"), schemas.EXPENSES
    ).awaitTermination()
    rows = read_facts(spark, ledger, schemas.EXPENSES)
    assert sorted(r.id for r in rows.collect()) == ["0", "1", "2", "3"]


def test_status_changes(spark, hall, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "bills"), schemas.OBLIGATIONS)
    table.replace(hall["obligations"])
    t = dt.datetime(2031, 11, 9)
    batches = [
        [("hall", "o0", "paid", None, None, t, 1), ("hall", "o1", "paid", None, None, t, 5)],
        [("hall", "o0", "due", None, None, t, 2), ("hall", "o0", "due", None, None, t, 2)],
        [("hall", "o1", "scheduled", None, None, t - dt.timedelta(days=1), 9)],
    ]
    stream = source(spark, str(tmp_path / "in"), schemas.STATUS_CHANGES, *batches)
    path = str(tmp_path / "latest")
    jobs.keep_latest_changes(stream, path, str(tmp_path / "cp")).awaitTermination()
    now = jobs.with_latest_changes(table.read(), path, merges.apply_obligation_changes)
    expected = merges.apply_obligation_changes(
        table.read(), spark.createDataFrame([r for b in batches for r in b], schemas.STATUS_CHANGES)
    )
    assert sorted(now.collect()) == sorted(expected.collect())
    status = {r.id: r.status for r in now.collect()}
    assert (status["o0"], status["o1"], status["o5"]) == ("due", "paid", "due")
    # a batch writes the entities that it met, not the table
    written = spark.read.parquet(path).groupBy("batch_id").count()
    assert sorted(r["count"] for r in written.collect()) == [1, 1, 2]
    assert jobs.fold_changes(table, path, merges.apply_obligation_changes) == 2
    assert sorted(table.read().collect()) == sorted(now.collect())


def test_live_totals(spark, tmp_path):
    parts = str(tmp_path / "live")
    stream = source(
        spark, str(tmp_path / "in"), schemas.EXPENSES,
        [expense("1", "2026-05-01", "a", "5"), expense("2", "2026-05-02", "a", "1")],
        [expense("3", "2026-05-20", "a", "9999999999.99"), expense("4", "2026-05-20", "a", "9999999999.99")],
        [expense("5", "2026-05-01", "a", "2")],
    )
    jobs.live_daily_totals(stream, parts, str(tmp_path / "cp"), "created_at").awaitTermination()
    found = {str(r.day): str(r.daily_total) for r in jobs.read_daily_totals(spark, parts).collect()}
    assert found == {"2026-05-01": "7.00", "2026-05-02": "1.00", "2026-05-20": "19999999999.98"}
    averages = jobs.read_moving_average(spark, parts, days=2).collect()
    assert [r.average for r in averages] == [(19999999999.98 + 1) / 2]
