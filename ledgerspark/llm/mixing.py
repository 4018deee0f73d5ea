"""Mixing of sources to target weights by capped water-filling.

Targets: all words are shared out by weight, sources above their cap (``max_epochs`` times
their size) are clamped to it, and the excess goes to the others by weight, until no source
is above. Each step is one aggregate over the table of sources; the driver sees three sums.

Sampling: every document is taken as often as its source's target holds the source whole; the
rest is filled by documents in the order of a seeded hash while they fit, and the gap left by
a document that did not fit is filled the same way again, ``fill_passes`` times. Running
sums go over hash buckets first and over the documents of one bucket second, so that a source
with a third of all documents is split over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import SPACED_WORD, repeated_rows, stored, text_key


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank (from 0, by code point, null last)."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    parts = stored(
        sums.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("part")
        .count()
        .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(offsets, "part").select(
        "source", "source_size", (place + F.col("offset") - 1).alias("rank")
    )


def fill_targets(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight); the weights are whole numbers."""
    cap = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, weights, clamped = total or 0, weights or 0, 0
    while weights:
        # share by exact whole numbers, one division: a rerun gives the same bits
        share = F.col("weight") * F.lit(left).cast("double") / F.lit(weights).cast("double")
        above = cap <= share
        capped, rest, count = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count_if(above),
        ).first()
        if count == clamped:
            return sources.withColumn("target", F.least(share, cap.cast("double")))
        left, weights, clamped = total - capped, rest, count
    return sources.withColumn("target", cap.cast("double"))


def fill_gap(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """``items`` with ``fits``: the prefix of each source, in hash order, that its gap holds.

    Documents already ``taken`` or larger than the gap are passed over.
    """
    open_items = items.join(gaps, F.col("source").eqNullSafe(F.col("gap_source"))).drop("gap_source")
    free = (F.col("extra") == 0) & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
    open_items = open_items.withColumn("step", F.when(free, F.col("size")).otherwise(F.lit(0)))
    steps = open_items.groupBy("source", "bucket").agg(F.sum("step").alias("bucket_sum"))
    before = (
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = steps.select(
        F.col("source").alias("at_source"),
        F.col("bucket").alias("at_bucket"),
        F.coalesce(F.sum("bucket_sum").over(before), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "text_a", "text_b")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = open_items.withColumn("inside", F.sum("step").over(inside))
    placed = running.join(
        offsets,
        F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket")),
    )
    fits = free & (F.col("offset") + F.col("inside") <= F.col("gap"))
    return placed.withColumn("extra", F.when(fits, 1).otherwise(F.col("extra"))).select(
        *items.columns
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    fill_passes: int = 3,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, times, text_a, text_b.

    ``size`` counts the words of the text (null text: 0), ``times`` how often the mix takes the
    document, ``taken`` the words that makes. The weights repeat over the sources by
    code point, null last. A source without words has target 0; its documents are taken
    ``max_epochs`` times 0 words. ``taken`` of a source never exceeds its target; what is
    missing is smaller than the documents passed over in the last pass. No document is taken
    more than ``max_epochs`` times. Rows repeated with one id are documents of
    their own. An empty table gives an empty result.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")))
    sizes = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            *text_key(F.col(text)),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.substring(place, 1, 3).alias("bucket"),
            F.substring(place, 4, 16).alias("place"),
        ),
        "mix-sizes",
    )
    ranked = ranked_sources(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked.withColumn("weight", weight.cast("long")), "mix-weights")
    targets = fill_targets(sources, max_epochs).select(
        F.col("source").alias("target_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(max_epochs)
        .alias("whole"),
    )
    same = F.col("source").eqNullSafe(F.col("target_source"))
    items = sizes.withColumn("extra", F.lit(0))
    for _ in range(fill_passes):
        spent = items.groupBy("source").agg(F.sum(F.col("extra") * F.col("size")).alias("spent"))
        gaps = spent.join(targets, same).select(
            F.col("source").alias("gap_source"),
            (F.col("target") - F.col("whole") * F.col("source_size") - F.col("spent")).alias("gap"),
        )
        items = stored(fill_gap(items, gaps), "mix-pass")
    times = (F.col("whole") + F.col("extra")).cast("int")
    return items.join(targets, same).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (times * F.col("size")).alias("taken"),
        times.alias("times"),
        "text_a",
        "text_b",
    )


def mixed_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    plan = mix(docs, doc_id, text, source, **options).withColumnRenamed("source", source)
    return repeated_rows(docs, plan, doc_id, text, [source])
