"""Action queue: candidates by rule, the synced queue, and drafts for single actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions.numbers import inr_full
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import ranking
from ledgerspark.operators.keyed import lookup_join, with_stand_in
from ledgerspark.operators.merges import sync_actions
from ledgerspark.plans.ledger import history

WS = "workspace_id"
CANDIDATE = [
    WS, "id", "title", "detail", "severity", "action_type", "target_entity", "status",
]


def obligation_actions(obligations: DataFrame, as_of) -> DataFrame:
    """Actions for the three unpaid obligations that are due first."""
    due = A.soonest_due(obligations, as_of)
    supplier = F.lower("category") == "supplier"
    days, amount = F.col("days"), inr_full(F.col("amount_inr"))
    when = F.when(days < 0, "overdue").otherwise(F.format_string("due in %d days", days))
    limit = F.when(supplier, V.SUPPLIER_CRITICAL_DAYS).otherwise(V.BILL_CRITICAL_DAYS)
    day = F.col("due_date").cast("string")
    return due.select(
        WS,
        F.concat(F.when(supplier, "draft-").otherwise("obligation-"), "id").alias("id"),
        F.when(supplier, F.format_string(V.SUPPLIER_ACTION_TITLE, "label"))
        .otherwise(F.format_string(V.BILL_ACTION_TITLE, "label"))
        .alias("title"),
        F.when(supplier, F.format_string(V.SUPPLIER_ACTION_DETAIL, amount, day))
        .otherwise(F.format_string(V.BILL_ACTION_DETAIL, amount, when))
        .alias("detail"),
        F.when(days <= limit, "critical").otherwise("warning").alias("severity"),
        F.when(supplier, "vendor_follow_up").otherwise("bill_review").alias("action_type"),
        F.col("label").alias("target_entity"),
        F.lit("open").alias("status"),
    )


def import_actions(jobs: DataFrame) -> DataFrame:
    """Review actions for the two imports confirmed last."""
    latest = ranking.head(history(jobs), "imports", 2)
    kind = F.replace(F.col("import_type"), F.lit("_"), F.lit(" "))
    day = F.coalesce(F.date_format("confirmed_at", "yyyy-MM-dd"), F.lit(""))
    return latest.select(
        WS,
        F.concat(F.lit("import-"), "job_id").alias("id"),
        F.format_string(V.IMPORT_ACTION_TITLE, kind).alias("title"),
        F.format_string(V.IMPORT_ACTION_DETAIL, "applied_count", "filename", day).alias("detail"),
        F.lit("info").alias("severity"),
        F.lit("review_import").alias("action_type"),
        F.col("import_type").alias("target_entity"),
        F.lit("watching").alias("status"),
    )


def candidate_actions(
    workspaces: DataFrame, obligations: DataFrame, jobs: DataFrame, as_of
) -> DataFrame:
    """Obligation and import actions; a workspace with neither gets the standing one."""
    found = obligation_actions(obligations, as_of).unionByName(import_actions(jobs))
    standing = workspaces.select(WS, *[F.lit(V.WATCH_STOCK[c]).alias(c) for c in CANDIDATE[1:]])
    return with_stand_in(found, standing, WS)


def action_queue(
    workspaces: DataFrame, obligations: DataFrame, jobs: DataFrame, stored: DataFrame, as_of, now
) -> DataFrame:
    """Stored actions after syncing with the candidates of the day.

    Every workspace has a candidate, if only the standing one, so all of them are active.
    """
    candidates = candidate_actions(workspaces, obligations, jobs, as_of)
    return sync_actions(stored, candidates, now, active=workspaces)


def touched_workspaces(since, *changes: tuple[DataFrame, str]) -> DataFrame:
    """Workspaces with a row after ``since`` in any of the (frame, time column) pairs.

    Bills by ``created_at``, status changes by ``ts`` and imports by ``confirmed_at`` are what the rules look at.
    """
    hit = [frame.filter(F.col(at) > F.lit(since).cast("timestamp")).select(WS) for frame, at in changes]
    found = hit[0]
    for more in hit[1:]:
        found = found.unionByName(more)
    return found.distinct()


def refreshed_queue(
    workspaces: DataFrame,
    obligations: DataFrame,
    jobs: DataFrame,
    stored: DataFrame,
    touched: DataFrame,
    as_of,
    now,
) -> DataFrame:
    """Stored actions with the queues of the ``touched`` workspaces synced, the others as they were.

    Candidates are derived from the rows of touched workspaces alone. The wording
    depends on the day, so a new ``as_of`` calls for a full sync (``action_queue``); within a day the
    result differs from that of a full sync only in that untouched rows keep ``updated_at``. Touched workspaces
    may repeat; one that is not among ``workspaces`` has its stored actions left as they are.
    """
    hit = touched.select(WS).distinct().join(workspaces, WS, "left_semi")

    def own(rows: DataFrame, spread: str, how: str = "left_semi") -> DataFrame:
        return lookup_join(rows, hit, [WS], [spread], how)

    synced = action_queue(
        workspaces.join(hit, WS, "left_semi"),
        own(obligations, "id"),
        own(jobs, "job_id"),
        own(stored, "id"),
        as_of,
        now,
    )
    return synced.unionByName(own(stored, "id", "left_anti").select(*synced.columns))


def action_drafts(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """Draft text per requested action.

    An unknown action falls back to the workspace's first supplier follow-up, then to the
    standing import review.
    """
    fields = ["action_type", "target_entity", "status"]
    exact = queue.select(
        WS, F.col("id").alias("action_id"), *[F.col(c).alias(f"_1{c}") for c in fields]
    )
    vendor = ranking.head(
        queue.filter(F.col("action_type") == "vendor_follow_up"), "actions", 1
    ).select(WS, *[F.col(c).alias(f"_2{c}") for c in fields])
    found = lookup_join(requests, exact, [WS, "action_id"], ["request_id"], only_used=True)
    found = lookup_join(found, vendor, [WS], ["request_id"])
    item = found.select(
        *requests.columns,
        *[
            F.coalesce(f"_1{c}", f"_2{c}", F.lit(V.FALLBACK_ACTION[c])).alias(c)
            for c in fields
        ],
    )
    rule = (
        F.when(F.col("action_type") == "bill_review", "bill_review")
        .when(F.col("action_type") == "review_import", "review_import")
        .when(F.col("status") == "snoozed", "snoozed")
        .otherwise("default")
    )
    item = item.withColumn("rule", rule)
    is_rule = {r: F.col("rule") == r for r in V.DRAFT_TEXTS}
    ledger = F.replace(F.col("target_entity"), F.lit("_"), F.lit(" "))
    draft = (
        F.when(is_rule["bill_review"], F.format_string(V.DRAFT_TEXTS["bill_review"], "target_entity"))
        .when(is_rule["review_import"], F.format_string(V.DRAFT_TEXTS["review_import"], ledger))
        .when(is_rule["snoozed"], F.format_string(V.DRAFT_TEXTS["snoozed"], "target_entity"))
        .otherwise(V.DRAFT_TEXTS["default"])
    )
    reason = F.lit(V.DRAFT_RATIONALES["default"])
    for name in ["snoozed", "review_import", "bill_review"]:
        reason = F.when(is_rule[name], V.DRAFT_RATIONALES[name]).otherwise(reason)
    return item.select(
        *requests.columns,
        "action_type",
        "target_entity",
        reason.alias("rationale"),
        draft.alias("draft_text"),
        (F.col("rule") != "review_import").alias("approval_required"),
    )
