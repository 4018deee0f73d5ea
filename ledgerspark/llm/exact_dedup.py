"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is one run of (digest, row) entries, in which equal digests are first made one
entry. The runs then meet in binomial rounds: a round deals the entries of ``2**bits`` neighbouring
runs out by ranges of (joint run, digest), so that each task takes a stretch of every one of them, merges
the stretches in order of digest and keeps the preferred row and the number of rows of each digest. What
it leaves is sorted for the next round. A hot digest is one entry of each run from the start, never all
its rows, and its rows learn the outcome run by run.

An entry stands for texts of one SHA-256, one length and one independent 64-bit hash. All
three are compared at every level, so entries merge only where the second and third verify
the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_rows, stored, text_key

KEY = ["digest", "n_bytes", "text_a"]


def _preferred(keep: str) -> Callable[[str], Column]:
    return F.max if keep == "largest" else F.min


def run_entries(rows: DataFrame, keep: str) -> DataFrame:
    """One entry per run and text: run, KEY, ``best`` (doc_id, row_id) and ``group_size``."""
    best = _preferred(keep)(F.struct("doc_id", "row_id"))
    return rows.groupBy("run", *KEY).agg(best.alias("best"), F.count("*").alias("group_size"))


def merge_runs(entries: DataFrame, rounds: int, keep: str) -> DataFrame:
    """One entry per text: KEY, ``best`` and ``group_size``."""
    best = _preferred(keep)
    last = entries.agg(F.max("run")).first()[0] or 0
    bits = max(1, -(-last.bit_length() // rounds))
    level = entries
    while True:
        # ranges of the very grouping columns: the aggregate takes the merged order as it is, without
        # another exchange or sort
        joint = level.withColumn("run", F.shiftright("run", bits))
        merged = joint.repartitionByRange("run", *KEY).sortWithinPartitions("run", *KEY)
        level = merged.groupBy("run", *KEY).agg(
            best("best").alias("best"), F.sum("group_size").alias("group_size")
        )
        last >>= bits
        if last == 0:
            return level.drop("run")


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: str = "largest",
    rounds: int = 2,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, text_a, text_b.

    Null text counts as empty. The row with the largest (``keep="smallest"``: smallest) id of
    equal texts stays; a null id is smaller than any other. Of rows repeated with the same
    id and text one stays, the one with the largest (smallest) row number. An empty table
    gives an empty result; other columns are not looked at.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    entries = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.spark_partition_id().alias("run"),
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(value, 256)).alias("digest"),
        F.octet_length(value).alias("n_bytes"),
        *text_key(F.col(text)),
    )
    runs = stored(entries, "digest-runs")
    of_runs = stored(run_entries(runs, keep), "digest-entries")
    groups = merge_runs(of_runs, rounds, keep)
    # back along the runs, so that the rows of a hot text are spread over its runs
    told = of_runs.select("run", *KEY).join(groups, KEY)
    return runs.join(told, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_a",
        "text_b",
    )


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return kept_rows(docs, exact_groups(docs, doc_id, text, **options), doc_id, text)
