"""Nearest chunks that skip whole blocks of a kept blocked index, with exact results.

Chunks of a workspace are put with the nearest of a few of them, the pivots, and cut into blocks of
bounded size. A block knows its pivot's direction and the smallest and largest angle of its chunks to
it, so by the triangle inequality of angles no chunk of it is nearer to a question than its bound.
A question first searches the blocks with the lowest bounds that hold k chunks; the k-th distance
found there is its reach, and only blocks with a bound within the reach are searched after that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.documents import CHUNK_BLOCK, QUESTION_BLOCK, WS, _blocks, _nearest_in_block
from ledgerspark.operators.keyed import lookup_join, top_k
from ledgerspark.session import stored

PIVOTS = 32
#: Room for rounding of angles, far above their error.
SLACK = 1e-7
CHUNK = ["document_id", "chunk_index"]
BLOCK = [WS, "pivot", "part"]
UNPLACED = -1  # pivot of chunks without direction


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them have a direction; the others are zero."""
    rows = np.stack(vectors.to_numpy()).astype("float64")
    with np.errstate(invalid="ignore", over="ignore"):
        length = np.linalg.norm(rows, axis=1)
    usable = np.isfinite(length) & (length > 0)
    units = np.zeros_like(rows)
    units[usable] = rows[usable] / length[usable, None]
    return units, usable


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def _directed(column: str) -> Column:
    """Whether a vector has a direction: a finite length above zero."""
    total = F.aggregate(column, F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    return (total > 0) & (total < float("inf"))


def _place(chunks: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if chunks.empty:
        return pd.DataFrame(columns=[WS, *CHUNK, "embedding", "pivot", "angle"])
    units, usable = _units(chunks["embedding"])
    pivot, angle = np.full(len(chunks), UNPLACED), np.zeros(len(chunks))
    if len(pivots):
        pivots = pivots.sort_values("pivot", ignore_index=True)
        angles = _angles(units, _units(pivots["centre"])[0])
        nearest = angles.argmin(axis=1)
        pivot = np.where(usable, pivots["pivot"].to_numpy()[nearest], UNPLACED)
        angle = np.where(usable, angles[np.arange(len(chunks)), nearest], 0.0)
    return chunks[[WS, *CHUNK, "embedding"]].assign(pivot=pivot.astype("int32"), angle=angle)


def pivot_chunks(chunks: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """At most ``pivots`` chunks of each workspace, the lowest by hash: WS, pivot, centre."""
    usable = chunks.filter(_directed("embedding"))
    order = [F.xxhash64(*CHUNK), *map(F.col, CHUNK)]
    return top_k(usable, [WS], order, pivots, "pivot").select(WS, "pivot", F.col("embedding").alias("centre"))


def block_chunks(
    chunks: DataFrame, pivots: int = PIVOTS, block: int = CHUNK_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The blocked chunks, and one row per block: its centre, angles and number of chunks.

    The chunks with their pivots, and the blocks, are written and read again, to be used by many
    searches; a chunk's part follows from its hash. Chunks with a NULL vector take no part; those
    without direction have blocks of their own.
    """
    rows = chunks.select(WS, *CHUNK, "embedding").filter(F.col("embedding").isNotNull())
    centres = stored(pivot_chunks(rows, pivots), "pivots")
    tasks = stored(_blocks(rows, block, "_tasks"), "place-tasks")
    task = F.pmod(F.xxhash64(*CHUNK), F.col("_tasks")).cast("int")
    dealt = lookup_join(rows, tasks, [WS], CHUNK, "inner").withColumn("_task", task).drop("_tasks")
    copies = centres.join(tasks, WS).withColumn("_task", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{n} {types[n]}" for n in [WS, *CHUNK, "embedding"]) + ", pivot int, angle double"
    cell = [WS, "_task"]
    placed = dealt.groupBy(*cell).cogroup(copies.drop("_tasks").groupBy(*cell)).applyInPandas(_place, schema)
    placed = stored(placed, "placed-chunks")
    parts = placed.groupBy(WS, "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    parts = stored(parts, "pivot-parts")
    part = F.pmod(F.xxhash64(F.lit("part"), *CHUNK), F.col("_parts")).cast("int")
    blocked = lookup_join(placed, parts, [WS, "pivot"], CHUNK, "inner").withColumn("part", part).drop("_parts")
    spans = blocked.groupBy(*BLOCK).agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("chunks")
    )
    return blocked, stored(spans.join(centres, [WS, "pivot"], "left"), "blocks")


def _choose(k: int, further: bool):
    """Blocks that a question searches first, or afterwards within its reach."""

    def choose(questions: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        names = [WS, "question_id", "embedding", "_qb", "pivot", "part"]
        if questions.empty or blocks.empty:
            return pd.DataFrame(columns=names)
        blocks = blocks.sort_values(["pivot", "part"], ignore_index=True)
        placed = (blocks["pivot"] != UNPLACED).to_numpy()
        units, usable = _units(questions["embedding"])
        low, high = blocks["low"].to_numpy(), blocks["high"].to_numpy()
        held = blocks["chunks"].to_numpy()
        centres = np.zeros((len(blocks), units.shape[1]))
        if placed.any():
            centres[placed] = _units(blocks["centre"][placed])[0]
        rows, columns = [], []
        for i in range(len(questions)):
            angle = _angles(units[i : i + 1], centres)[0]
            bound = 1.0 - np.cos(np.maximum(0.0, np.maximum(angle - high, low - angle)))
            # a question without direction is as far from all chunks
            bound = np.where(placed, bound, np.inf) if usable[i] else np.zeros(len(blocks))
            order = np.lexsort((angle, bound))
            first = np.searchsorted(np.cumsum(held[order]), k) + 1
            picked = order[:first]
            if further:
                rest = order[first:]
                picked = rest[bound[rest] <= questions["reach"].iat[i] + SLACK]
            rows += [i] * len(picked)
            columns += picked.tolist()
        found = questions.iloc[rows][names[:4]].reset_index(drop=True)
        return found.assign(pivot=blocks["pivot"].to_numpy()[columns], part=blocks["part"].to_numpy()[columns])

    return choose


def visits(questions: DataFrame, blocks: DataFrame, k: int, question_block: int = QUESTION_BLOCK) -> DataFrame:
    """(question, block) pairs to search: the first ones, or with a column ``reach`` those after them."""
    further = "reach" in questions.columns
    tasks = stored(_blocks(questions, question_block, "_nq"), "question-tasks")
    qb = F.pmod(F.xxhash64("question_id"), F.col("_nq")).cast("int")
    dealt = lookup_join(questions, tasks, [WS], ["question_id"], "inner").withColumn("_qb", qb).drop("_nq")
    copies = lookup_join(blocks, tasks, [WS], ["pivot", "part"], "inner")
    copies = copies.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))).drop("_nq")
    types = {f.name: f.dataType.simpleString() for f in questions.schema}
    schema = ", ".join(f"{n} {types[n]}" for n in [WS, "question_id", "embedding"]) + ", _qb int, pivot int, part int"
    cell = [WS, "_qb"]
    chosen = dealt.groupBy(*cell).cogroup(copies.groupBy(*cell)).applyInPandas(_choose(k, further), schema)
    return stored(chosen, "block-visits")


def _search(visited: DataFrame, blocked: DataFrame, k: int) -> DataFrame:
    needed = stored(visited.groupBy(*BLOCK).agg(F.collect_set("_qb").alias("_qbs")), "visited-blocks")
    chunks = lookup_join(blocked, needed, BLOCK, CHUNK, "inner").withColumn("_qb", F.explode("_qbs")).drop("_qbs")
    types = {f.name: f.dataType.simpleString() for f in [*visited.schema, *blocked.schema]}
    schema = ", ".join(f"{n} {types[n]}" for n in [WS, "question_id", *CHUNK]) + ", distance double"
    cell = [*BLOCK, "_qb"]
    found = visited.groupBy(*cell).cogroup(chunks.groupBy(*cell)).applyInPandas(_nearest_in_block(k), schema)
    return stored(found, "block-nearest")


def nearest_in_blocks(
    questions: DataFrame, blocked: DataFrame, blocks: DataFrame, k: int = 3, question_block: int = QUESTION_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Exact k nearest chunks per question, and per workspace the blocks compared and skipped.

    The rows equal those of ``documents.nearest_chunks``: distances count to twelve places, ties go by
    document and chunk, vectors without direction have no distance (NULL) and come last. Questions
    with a NULL vector, or in a workspace without chunks, have no rows.
    """
    q = questions.select(WS, "question_id", "embedding").filter(F.col("embedding").isNotNull())
    first = visits(q, blocks, k, question_block)
    near = _search(first, blocked, k)
    order = [F.col("distance").asc_nulls_last(), *map(F.col, CHUNK)]
    best = top_k(near, [WS, "question_id"], order, k, "ord")
    # fewer than k distances leave the reach open
    reach = best.groupBy(WS, "question_id").agg(
        F.when(F.count("distance") == k, F.max("distance")).otherwise(float("inf")).alias("reach")
    )
    rest = visits(q.join(reach, [WS, "question_id"]), blocks, k, question_block)
    found = near.unionByName(_search(rest, blocked, k))
    compared = first.unionByName(rest).groupBy(WS).agg(
        F.count("*").alias("compared"), F.count_distinct("question_id").alias("asked")
    )
    whole = blocks.groupBy(WS).agg(F.count("*").alias("blocks"))
    skipped = F.col("asked") * F.col("blocks") - F.col("compared")
    report = compared.join(whole, WS).select(WS, "asked", "blocks", "compared", skipped.alias("skipped"))
    return top_k(found, [WS, "question_id"], order, k, "ord"), report
