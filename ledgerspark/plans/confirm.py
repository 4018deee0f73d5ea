"""Confirmation run: staged rows of the requested jobs into the stored ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.operators import imports, merges
from ledgerspark.operators.keyed import not_in
from ledgerspark.schemas import LEDGERS
from ledgerspark.session import stored
from ledgerspark.sources.tables import VersionedTable, append_batch, read_facts


def ledger_rows(typed: DataFrame, collection: str, now) -> DataFrame:
    """Coerced rows in the shape of their ledger, with an id from job and row number."""
    full = typed.withColumns(
        {
            "id": F.sha2(F.concat_ws("\x1f", "workspace_id", "job_id", "row_index"), 256),
            "created_at": F.lit(now).cast("timestamp"),
        }
    )
    return full.select([f.name for f in LEDGERS[collection]["schema"]])


def confirm_jobs(
    spark: SparkSession,
    jobs: VersionedTable,
    products: VersionedTable,
    staged: DataFrame,
    requested: DataFrame,
    root: str,
    run_id: str,
    as_of,
    now,
) -> DataFrame:
    """Apply the pending requested jobs and mark them; returns the outcome per job.

    Facts go below ``root`` as a batch of this run and these jobs, products are merged, the
    job table is replaced last. A fact that another run has stored already is left out; only the
    stored keys of the asked workspaces are compared. A run that failed is repeated under its
    ``run_id`` and then writes the same batches again; a confirmed job is never applied twice.
    """
    before = jobs.read()
    asked = requested.select("workspace_id", "job_id").distinct()
    # the same run for other jobs is another batch
    marks = asked.agg(F.count("*"), F.bit_xor(F.xxhash64("workspace_id", "job_id"))).first()
    batch_id = f"{run_id}-{marks[0]}-{marks[1] or 0:x}"
    outcome = imports.confirmation(before, requested, staged)
    # the staged rows meet their jobs once; every collection reads what was found
    pending = stored(imports.pending_rows(before, requested, staged), "pending-rows")
    for collection in V.COLLECTIONS:
        rows = imports.rows_to_apply(before, requested, staged, collection, pending)
        typed = imports.coerce_rows(rows, collection, as_of)
        if collection == "products":
            batch = typed.withColumn("created_at", F.lit(now).cast("timestamp"))
            merged = merges.upsert_products(products.read(), batch, ["job_id", "row_index"])
            products.replace(merged)
        else:
            facts = ledger_rows(typed, collection, now)
            day = LEDGERS[collection]["date"]
            path, schema = f"{root}/{collection}", LEDGERS[collection]["schema"]
            # a fact's id is made of its workspace and job, so only the asked workspaces can hold it
            held = read_facts(spark, path, schema, skip_batch=batch_id)
            held = held.join(asked.select("workspace_id").distinct(), "workspace_id", "left_semi")
            facts = not_in(facts, held, ["workspace_id", "id"])
            append_batch(facts, path, batch_id, ["workspace_id", day, "id"])
    jobs.replace(imports.confirmed_jobs(before, outcome, now))
    return outcome
