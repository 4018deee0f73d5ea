"""Loads and merges of incoming rows into stored ledger tables.

Both sides of every merge hold one row per key when they meet: incoming rows are reduced
first (with a map-side limit), so no key can be hot in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules
from ledgerspark.functions.text import strip
from ledgerspark.operators.keyed import first_per_key, lookup_join, not_in


def idempotent_load(
    stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str]
) -> DataFrame:
    """Incoming rows to append: first per key in batch order, absent from ``stored``.

    Running it again on the grown table gives no rows.
    """
    fresh = first_per_key(incoming, key, [F.col(c) for c in order])
    return not_in(fresh, stored, key)


def upsert(
    stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str], keep: list[str] = ()
) -> DataFrame:
    """Stored rows overwritten by the last incoming row of their key, plus new keys.

    A NULL in the incoming row overwrites too; columns in ``keep`` stay as stored.
    """
    latest = first_per_key(incoming, key, [F.col(c).desc_nulls_last() for c in order])
    values = [c for c in stored.columns if c not in key]
    src = latest.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(1).alias("_new"))
    tgt = stored.withColumn("_old", F.lit(1))
    columns = []
    for c in stored.columns:
        if c in key:
            columns.append(F.col(c))
        elif c in keep:
            columns.append(F.when(F.col("_old") == 1, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_new") == 1, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
    return tgt.join(src, key, "full_outer").select(*columns)


def upsert_products(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Product table after a batch; rows without a sku are skipped, the last row wins."""
    usable = incoming.filter(F.trim("sku") != "")
    return upsert(stored, usable, ["workspace_id", "sku"], order, keep=["created_at"])


def upsert_documents(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Document table after a batch: kind and summary refreshed by title and upload day."""
    return upsert(
        stored,
        incoming,
        ["workspace_id", "title", "uploaded_at"],
        order,
        keep=["document_id", "created_at"],
    )


def replace_chunks(stored: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table where the chunks of changed documents give way to fresh ones."""
    key = ["workspace_id", "document_id"]
    ids = changed.select(*key).distinct()
    return stored.join(ids, key, "left_anti").unionByName(fresh.select(*stored.columns))


def upsert_settings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Provider settings after a batch of saves; the latest save of a workspace wins."""
    return upsert(stored, incoming, ["workspace_id"], ["updated_at", "mode"]).withColumns(
        {
            "mode": rules.provider_mode(F.col("mode")),
            "providers": rules.provider_list(F.col("providers")),
        }
    )


def settings_for(workspaces: DataFrame, settings: DataFrame) -> DataFrame:
    """Mode and providers of every workspace, local and empty where none was saved."""
    return workspaces.select("workspace_id").join(settings, "workspace_id", "left").select(
        "workspace_id",
        rules.provider_mode(F.col("mode")).alias("mode"),
        rules.provider_list(F.col("providers")).alias("providers"),
    )


def sync_actions(
    stored: DataFrame, candidates: DataFrame, now, active: DataFrame | None = None
) -> DataFrame:
    """Action table after a run of the rules.

    ``active`` names the workspaces that have candidates where the caller knows them; otherwise they
    are taken from the candidates, which then are derived twice.

    Candidates refresh the wording of stored items and keep their status, snooze day and
    note. Open or watching items that are no candidate any more go, but only in workspaces
    that have candidates; snoozed and resolved ones stay.
    """
    key = ["workspace_id", "id"]
    refreshed = ["title", "detail", "severity", "action_type", "target_entity"]
    fresh = candidates.select(
        *key, *[F.col(c).alias(f"_{c}") for c in [*refreshed, "status"]], F.lit(1).alias("_new")
    )
    active = (candidates if active is None else active).select("workspace_id").distinct()
    active = active.withColumn("_active", F.lit(1))
    new, old = F.col("_new") == 1, F.col("_old") == 1
    joined = (
        stored.withColumn("_old", F.lit(1))
        .join(fresh, key, "full_outer")
    )
    joined = lookup_join(joined, active, ["workspace_id"], ["id"])
    stale = F.coalesce(
        F.col("_new").isNull()
        & F.col("status").isin("open", "watching")
        & F.col("_active").isNotNull(),
        F.lit(False),
    )
    stamp = F.lit(now).cast("timestamp")
    return joined.filter(~stale).select(
        *key,
        *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in refreshed],
        F.when(old, F.col("status")).otherwise(F.col("_status")).alias("status"),
        "snoozed_until",
        "resolution_note",
        F.when(old, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(new, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change per entity by time, then by change id."""
    return first_per_key(
        changes, ["workspace_id", "entity_id"], [F.col("ts").desc(), F.col("change_id").desc()]
    )


def new_obligations(requests: DataFrame) -> DataFrame:
    """Obligations entered by hand: trimmed, rounded and normalised; status due by default."""
    return requests.withColumns(
        {
            "label": strip(F.col("label")),
            "category": strip(F.col("category")),
            "amount_inr": F.round("amount_inr", 2).cast("decimal(12,2)"),
            "recurrence": rules.recurrence(F.col("recurrence")),
            "status": rules.obligation_status(F.coalesce("status", F.lit("due"))),
        }
    )


def apply_obligation_changes(obligations: DataFrame, changes: DataFrame) -> DataFrame:
    """Obligations with their latest status; changes to unknown ids do nothing."""
    last = latest_changes(changes).select(
        "workspace_id", F.col("entity_id").alias("id"), F.col("status").alias("_status"),
        F.lit(1).alias("_hit"),
    )
    status = F.when(F.col("_hit") == 1, rules.obligation_status(F.col("_status"))).otherwise(
        F.col("status")
    )
    return (
        obligations.join(last, ["workspace_id", "id"], "left")
        .withColumn("status", status)
        .select(*obligations.columns)
    )


def unknown_changes(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Latest changes whose entity is not stored."""
    ids = stored.select("workspace_id", F.col(key).alias("entity_id"))
    return latest_changes(changes).join(ids, ["workspace_id", "entity_id"], "left_anti")


def apply_action_changes(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """Actions with their latest status; an unknown id becomes a manual action."""
    last = latest_changes(changes).select(
        "workspace_id",
        F.col("entity_id").alias("id"),
        rules.action_status(F.col("status")).alias("_status"),
        F.col("snooze_until").alias("_snooze"),
        F.col("resolution_note").alias("_note"),
        F.col("ts").alias("_ts"),
    )
    changed, known = F.col("_status").isNotNull(), F.col("_old") == 1

    def pick(new, old: str):
        return F.when(changed, new).otherwise(F.col(old)).alias(old)

    def keep(name: str):
        return F.when(known, F.col(name)).otherwise(V.MANUAL_ACTION[name]).alias(name)

    return (
        actions.withColumn("_old", F.lit(1))
        .join(last, ["workspace_id", "id"], "full_outer")
        .select(
            "workspace_id",
            "id",
            *[keep(c) for c in ["title", "detail", "severity", "action_type", "target_entity"]],
            pick(F.col("_status"), "status"),
            pick(F.when(F.col("_status") == "snoozed", F.col("_snooze")), "snoozed_until"),
            pick(F.when(F.col("_status") == "resolved", F.col("_note")), "resolution_note"),
            F.when(known, F.col("created_at")).otherwise(F.col("_ts")).alias("created_at"),
            pick(F.col("_ts"), "updated_at"),
        )
    )
