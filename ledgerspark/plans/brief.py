"""Daily owner brief and its run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import rules
from ledgerspark.functions.numbers import inr_full
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import ranking
from ledgerspark.operators.imports import union_all
from ledgerspark.operators.keyed import with_stand_in

WS = "workspace_id"
SNAPSHOT = ["Revenue snapshot: ", "Gross margin snapshot: ", "Bills due soon: "]


def _placeholder(workspaces: DataFrame, section: str, text: str) -> DataFrame:
    return workspaces.select(
        WS, F.lit(section).alias("section"), F.lit("").alias("sort_key"), F.lit(text).alias("text")
    )


def due_today_lines(obligations: DataFrame, as_of) -> DataFrame:
    """A line per unpaid obligation due on the day or overdue.

    ``sort_key`` puts them in display order; a workspace may have any number.
    """
    due = A.due_today(obligations, as_of)
    return due.select(
        WS,
        F.lit("due_today").alias("section"),
        F.concat_ws(
            "|",
            rules.obligation_rank(F.col("status")).cast("string"),
            F.col("due_date").cast("string"),
            "label",
            "id",
        ).alias("sort_key"),
        F.concat("label", F.lit(" — "), inr_full(F.col("amount_inr"))).alias("text"),
    )


def owner_brief(
    workspaces: DataFrame,
    stats: DataFrame,
    alerts: DataFrame,
    obligations: DataFrame,
    queue: DataFrame,
    as_of,
) -> DataFrame:
    """The brief as lines (section, sort_key, text); empty sections get a placeholder."""
    lead = F.element_at(F.array(*[F.lit(s) for s in SNAPSHOT]), F.col("ord"))
    items = stats.filter(F.col("ord") <= 3).select(
        WS,
        F.lit("items").alias("section"),
        F.col("ord").cast("string").alias("sort_key"),
        F.concat(lead, "value").alias("text"),
    )
    due = due_today_lines(obligations, as_of)
    anomalies = alerts.filter(F.col("severity").isin("critical", "warning")).select(
        WS,
        F.lit("anomalies").alias("section"),
        F.col("ord").cast("string").alias("sort_key"),
        F.col("title").alias("text"),
    )
    suggested = ranking.head(queue, "actions", 2).select(
        WS,
        F.lit("suggested").alias("section"),
        F.col("ord").cast("string").alias("sort_key"),
        F.col("title").alias("text"),
    )
    # any number of bills may be due, so who has none is found apart; the other sections are short
    without = workspaces.select(WS).join(due.select(WS).distinct(), WS, "left_anti")
    return union_all(
        [
            items,
            due,
            _placeholder(without, "due_today", V.NOTHING_DUE_TODAY),
            with_stand_in(anomalies, _placeholder(workspaces, "anomalies", V.NO_ANOMALIES), WS),
            with_stand_in(suggested, _placeholder(workspaces, "suggested", V.NO_SUGGESTIONS), WS),
        ]
    )


def run_log(workspaces: DataFrame, alerts: DataFrame, obligations: DataFrame, as_of) -> DataFrame:
    """Counts of one brief run; a placeholder line counts, so neither is below 1."""
    anomalies = (
        alerts.filter(F.col("severity").isin("critical", "warning"))
        .groupBy(WS)
        .agg(F.count("*").alias("_anomalies"))
    )
    due = A.due_today(obligations, as_of).groupBy(WS).agg(F.count("*").alias("_due"))
    day = F.lit(as_of).cast("date").cast("string")
    run_id = F.substring(F.sha2(F.concat_ws("\x1f", WS, day), 256), 1, 32)

    def at_least_one(name: str):
        return F.greatest(F.coalesce(name, F.lit(0)), F.lit(1)).cast("bigint")

    return A.per_workspace(workspaces, anomalies, due).select(
        WS,
        F.concat(F.lit("brief-"), run_id).alias("morning_brief_id"),
        at_least_one("_anomalies").alias("anomaly_count"),
        at_least_one("_due").alias("due_reminder_count"),
    )
