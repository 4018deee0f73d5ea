"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
    larger = both.where("b > a")
    return larger.join(least, larger["a"] == least["of"]).select(
        F.col("b").alias("a"), F.col("least").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them (a > b throughout)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
    moved = edges.join(least, edges["a"] == least["of"]).where("b > least")
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select(F.col("of").alias("a"), F.col("least").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """(a, b) with a > b: every node that is not the smallest of its component, and the smallest.

    ``links`` holds pairs (a, b) of whole numbers, in any order, repeated or not. A node's
    neighbours are never gathered: each step is two aggregates and two joins, its result a
    written table. The loop ends when a step changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.where("a > b").distinct(), "links")
    seen = _mark(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums: equal marks mean equal edge sets but for a chance of 2^-64."""
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    again = F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed), F.sum(again)).first())
