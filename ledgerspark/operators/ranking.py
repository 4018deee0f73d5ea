"""Display orders: sorted listings, with positions where they are asked for.

A listing is a total sort by workspace and the order's columns; Spark range-partitions it,
so a large workspace is sorted by many tasks. ``position`` numbers it from 0 per workspace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import rules
from ledgerspark.operators.keyed import number_by_range, number_rows, top_k

WS = "workspace_id"


def _descending(column: str):
    """Sort key that grows as the column falls, NULL last."""
    return F.coalesce(-F.unix_micros(F.col(column).cast("timestamp")), F.lit(2**62))


ORDERS = {
    # due, scheduled, paid; then due day, label
    "obligations": lambda: {
        "_1": rules.obligation_rank(F.col("status")),
        "_2": F.col("due_date"),
        "_3": F.col("label"),
        "_4": F.col("id"),
    },
    # open, watching, snoozed, other; then last touched first
    "actions": lambda: {
        "_1": rules.action_rank(F.col("status")),
        "_2": _descending("updated_at"),
        "_3": F.col("id"),
    },
    # newest upload first
    "documents": lambda: {
        "_1": _descending("uploaded_at"),
        "_2": _descending("created_at"),
        "_3": F.col("document_id"),
    },
    # last confirmed first, never confirmed last
    "imports": lambda: {
        "_1": _descending("confirmed_at"),
        "_2": _descending("created_at"),
        "_3": F.col("job_id"),
    },
    # longest member first
    "members": lambda: {"_1": F.col("created_at"), "_2": F.col("user_id")},
}


DAY = 24 * 3600 * 1_000_000


def _days(key: str):
    """Whole days of a ``_descending`` key."""
    return F.floor(F.col(key) / DAY)


# coarse values that never fall along the order
BLOCKS = {
    "obligations": lambda: [F.col("_1"), F.col("_2")],
    "actions": lambda: [F.col("_1"), _days("_2")],
    "documents": lambda: [_days("_1"), _days("_2")],
    "imports": lambda: [_days("_1"), _days("_2")],
    "members": lambda: [F.to_date("_1")],
}


def listing(rows: DataFrame, order: str) -> DataFrame:
    """Rows sorted by workspace and display order."""
    return rows.orderBy(WS, *ORDERS[order]().values())


def with_position(
    rows: DataFrame, order: str, name: str = "position", block_rows: int | None = 1_000_000
) -> DataFrame:
    """Rows with their place in the display order of their workspace, from 0.

    A block of the order (a status and a day) with more than ``block_rows`` rows, such as the queue
    of one sync, would be one large task; then rows are numbered by ranges of the whole order.
    ``None`` leaves the count of the blocks out.
    """
    keys = ORDERS[order]()
    keyed = rows.withColumns(keys)
    if block_rows is not None:
        blocks = keyed.groupBy(WS, *BLOCKS[order]()).agg(F.count("*").alias("rows"))
        if (blocks.agg(F.max("rows")).first()[0] or 0) > block_rows:
            return number_by_range(keyed, [WS], list(keys), name).drop(*keys)
    return number_rows(keyed, [WS], list(keys), name, BLOCKS[order]()).drop(*keys)


def head(rows: DataFrame, order: str, k: int) -> DataFrame:
    """First ``k`` rows of each workspace in display order, ``ord`` from 1."""
    return top_k(rows, [WS], list(ORDERS[order]().values()), k, "ord")
