"""Import ledger: confirmed imports and a summary of every collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.operators import aggregates as A
from ledgerspark.operators.imports import union_all
from ledgerspark.schemas import LEDGERS

WS = "workspace_id"


def history(jobs: DataFrame) -> DataFrame:
    """Confirmed imports."""
    return jobs.filter(F.col("status") == "confirmed").select(
        WS, "job_id", "import_type", "filename", "row_count", "applied_count",
        "created_at", "confirmed_at",
    )


def latest_imports(jobs: DataFrame) -> DataFrame:
    """Time of the last confirmed import per workspace and collection."""
    return (
        history(jobs).groupBy(WS, "import_type").agg(F.max("confirmed_at").alias("latest_import_at"))
    )


def collection_summaries(
    workspaces: DataFrame,
    ledgers: dict[str, DataFrame],
    jobs: DataFrame,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Per workspace and collection: row count, last import, columns, latest rows.

    With ``counts`` from kept sums, ``ledgers`` may hold the kept lead rows only.
    """
    counts = A.row_counts(ledgers) if counts is None else counts
    kinds = F.array(*[F.lit(k) for k in V.COLLECTIONS])
    base = workspaces.select(WS, F.explode(kinds).alias("import_type"))
    samples = union_all([A.sample_rows(ledgers[k], k) for k in V.COLLECTIONS])
    key = [WS, "import_type"]
    columns = F.create_map(
        *[
            part
            for kind in V.COLLECTIONS
            for part in (F.lit(kind), F.array(*map(F.lit, LEDGERS[kind]["columns"])))
        ]
    )
    return (
        base.join(counts, key, "left")
        .join(latest_imports(jobs), key, "left")
        .join(samples, key, "left")
        .select(
            *key,
            F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
            "latest_import_at",
            columns[F.col("import_type")].alias("columns"),
            F.coalesce("sample_rows", F.array().cast("array<array<string>>")).alias(
                "sample_rows"
            ),
        )
    )
