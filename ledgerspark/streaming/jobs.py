"""Structured Streaming versions of the arrival paths.

Every sink writes through ``foreachBatch`` under the batch id, so a batch that is run
again after a failure replaces its own output. The checkpoint and the tables belong in
storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerspark import fixed_values as V
from ledgerspark.operators import aggregates, merges
from ledgerspark.operators.imports import split_valid
from ledgerspark.schemas import LEDGERS, STATUS_CHANGES, table_schema
from ledgerspark.sources.tables import VersionedTable, append_batch, read_facts


DAILY_PARTS = table_schema("workspace_id string, day date, amount_sum decimal(22,2)")


def _start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    def kept(batch: DataFrame, batch_id: int) -> None:
        # a batch is used several times; without this its source is read as often
        batch.persist()
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(kept)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**trigger)
        .start()
    )


def ingest_entries(
    entries: DataFrame,
    collection: str,
    ledger: str,
    rejects: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Daily entries: accepted rows to the ledger, the others with reasons to ``rejects``."""
    cluster = ["workspace_id", LEDGERS[collection]["date"], "id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"{collection}-{batch_id}"
        valid, rejected = split_valid(batch, collection)
        append_batch(valid, ledger, name, cluster)
        append_batch(rejected, rejects, name)

    return _start(entries, write, checkpoint, trigger or {"availableNow": True})


def ingest_once(
    entries: DataFrame,
    collection: str,
    order: list[str],
    ledger: str,
    checkpoint: str,
    schema: T.StructType,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest that takes each natural key once, however late it is delivered again.

    Of a batch's rows the first per key in ``order`` is kept, unless the ledger has that key
    already. No state is held, so no row is too late. The day is part of the key and the
    ledger is clustered by workspace and day, so only files that may hold the batch's days
    are read.
    """
    key, day = LEDGERS[collection]["key"], LEDGERS[collection]["date"]
    cluster = ["workspace_id", day, "id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"{collection}-{batch_id}"
        first, last = batch.agg(F.min(day), F.max(day)).first()
        stored = read_facts(batch.sparkSession, ledger, schema, skip_batch=name)
        stored = stored.filter(F.col(day).between(first, last))
        new = merges.idempotent_load(stored, batch, key, order)
        append_batch(new.select([f.name for f in schema]), ledger, name, cluster)

    return _start(entries, write, checkpoint, trigger or {"availableNow": True})


def keep_latest_changes(
    changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """The last change of every entity as streaming state; a batch writes the entities it met.

    State holds one change per entity, the last by time and change id, so neither the order of
    arrival nor a repeated delivery matters and no row is too late. A batch of k changes
    writes at most k rows below ``path``, whatever the size of the table they apply to.
    """
    order = ["ts", "change_id"]
    rest = [f.name for f in STATUS_CHANGES if f.name not in ("workspace_id", "entity_id", *order)]
    last = changes.groupBy("workspace_id", "entity_id").agg(F.max(F.struct(*order, *rest)).alias("last"))
    latest = last.select("workspace_id", "entity_id", "last.*").select([f.name for f in STATUS_CHANGES])

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, path, f"changes-{batch_id}")

    return (
        latest.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def with_latest_changes(
    rows: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """``rows`` as the changes kept below ``path`` leave them.

    ``merge`` is ``apply_obligation_changes`` or ``apply_action_changes``; it takes the last of
    an entity's changes, so rows that already hold them stay as they are.
    """
    return merge(rows, read_facts(rows.sparkSession, path, STATUS_CHANGES))


def fold_changes(
    table: VersionedTable, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]
) -> int:
    """Writes the kept changes into their table, now and then instead of with every batch."""
    return table.replace(with_latest_changes(table.read(), path, merge))


def live_daily_totals(
    entries: DataFrame,
    path: str,
    checkpoint: str,
    event_time: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Sums per workspace and day of every batch, kept under the batch's name.

    ``read_daily_totals`` adds them up. A late row changes its day's total like any other;
    a batch that is run again replaces its own sums.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("workspace_id", F.to_date(event_time).alias("day")).agg(
            F.sum("amount_inr").cast("decimal(22,2)").alias("amount_sum")
        )
        append_batch(sums, path, f"totals-{batch_id}")

    return _start(entries, write, checkpoint, trigger or {"availableNow": True})


def read_daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """Running totals per workspace and day: the sums of all batches."""
    parts = read_facts(spark, path, DAILY_PARTS)
    total = F.sum("amount_sum").cast("decimal(22,2)").alias("daily_total")
    return parts.groupBy("workspace_id", "day").agg(total)


def read_moving_average(spark: SparkSession, path: str, days: int = V.MOVING_AVERAGE_DAYS) -> DataFrame:
    """Mean of the last days with data per workspace, of live totals.

    Whatever arrived late counts for its own day: it may raise a day that is among the last ones,
    or take the place of an older one. Each task passes on the last days it met, no more.
    """
    return aggregates.moving_average(read_daily_totals(spark, path), days)
