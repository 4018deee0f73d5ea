"""Document chunks, their vectors, and nearest chunks of questions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark import fixed_values as V
from ledgerspark.functions import text
from ledgerspark.operators.keyed import lookup_join, top_k
from ledgerspark.session import stored

WS = "workspace_id"
CHUNK_BLOCK = 65536
QUESTION_BLOCK = 65536
#: Pairs whose products are made at once inside a task.
CHUNK_TILE = 4096
QUESTION_TILE = 128


def document_chunks(documents: DataFrame, column: str = "summary") -> DataFrame:
    """Numbered 280-character pieces of a text column, whole text."""
    return documents.select(
        WS, "document_id", F.posexplode(text.chunks(F.col(column))).alias("chunk_index", "content")
    )


def embed(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("embedding", text.embedding(F.col(column)))


def index_chunks(documents: DataFrame, column: str = "summary") -> DataFrame:
    """Chunks with their vectors.

    Chunks are spread by hash before they are embedded: one very long document, or a file
    with few row groups, would otherwise keep a single task busy.
    """
    chunks = document_chunks(documents, column)
    return embed(chunks.repartition(WS, "document_id", "chunk_index"), "content")


def chunk_titles(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the title of their document.

    A document is one cell, so its chunks are few next to a workspace's; adaptive
    execution splits the partition of an unusually long one.
    """
    titles = documents.select(WS, "document_id", "title")
    return chunks.join(titles, [WS, "document_id"])


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Number of blocks of about ``size`` rows each workspace's rows are cut into.

    Joins take these counts stored: then Spark knows that they are small, and vectors need not be shuffled
    to meet them.
    """
    return rows.groupBy(WS).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def _first_copies(vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each distinct vector; a later copy is never among k nearest."""
    rows = np.ascontiguousarray(vectors)
    _, same = np.unique(rows.view(f"V{rows.strides[0]}").ravel(), return_inverse=True)
    return np.flatnonzero(pd.Series(same).groupby(same).cumcount().to_numpy() < k)


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first k of each question by distance, then place; missing distances come last."""
    question, place, distance = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, distance, question))
    question, place, distance = question[order], place[order], distance[order]
    starts = np.flatnonzero(np.r_[True, question[1:] != question[:-1]]) if len(question) else []
    rank = np.arange(len(question)) - np.repeat(starts, np.diff(np.r_[starts, len(question)]).astype(int))
    kept = rank < k
    return question[kept], place[kept], distance[kept]


def _compared(questions: np.ndarray, chunks: np.ndarray, question: np.ndarray, place: np.ndarray):
    # sums differ in the last digits by block; twelve places make equal ones ties
    with np.errstate(invalid="ignore"):
        dots = np.einsum("ij,ij->i", questions[question], chunks[place])
        return question, place, np.round(1.0 - dots, 12) + 0.0


def _nearest_rows(questions: np.ndarray, chunks: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(question, chunk, distance) of the k nearest chunks of every question, ties by the chunk's place.

    Products in single precision, tile by tile, tell which pairs may be among the k nearest: the
    bound leaves room for more than their error. Only those pairs are compared in double
    precision, so the result is that of comparing all of them.
    """
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not len(questions) or not len(chunks):
        return empty
    # rows without direction are compared one by one, the k first of each vector
    whole = np.isfinite(chunks).all(axis=1)
    odd = np.flatnonzero(~whole)
    odd = odd[_first_copies(chunks[odd], k)] if len(odd) else odd
    plain = np.flatnonzero(whole)
    plain = plain[_first_copies(chunks[plain], k)] if len(plain) else plain
    room = (chunks.shape[1] + 8) * 2.0**-23 + 1e-11
    near32 = np.ascontiguousarray(chunks[plain].astype("float32"))
    found = [empty]
    asks = np.isfinite(questions).all(axis=1)
    # without direction a question has no distance to any chunk: the first ones by place stand for all
    lost = np.isnan(questions).any(axis=1)
    first, every = np.arange(min(k, len(chunks))), np.arange(len(chunks))
    for start in range(0, len(questions), QUESTION_TILE):
        rows = np.arange(start, min(start + QUESTION_TILE, len(questions)))
        best = empty
        for kind, places in ((asks, odd), (lost, first), (~asks & ~lost, every)):
            some = rows[kind[rows]]
            if len(some) and len(places):
                pair = (np.repeat(some, len(places)), np.tile(places, len(some)))
                best = _best([best, _compared(questions, chunks, *pair)], k)
        rows = rows[asks[rows]]
        asked32 = questions[rows].astype("float32")
        least = np.full(len(rows), -np.inf, "float32")
        for at in range(0, len(plain) if len(rows) else 0, CHUNK_TILE):
            alike = asked32 @ near32[at : at + CHUNK_TILE].T
            if at == 0 and alike.shape[1] > k:
                least = np.partition(alike, -k, axis=1)[:, -k] - np.float32(2 * room)
            hit = np.flatnonzero(alike >= least[:, None])
            if not len(hit):
                continue
            own, place = np.divmod(hit, alike.shape[1])
            best = _best([best, _compared(questions, chunks, rows[own], plain[at + place])], k)
            # the k-th distance so far bounds what may still come
            held = np.bincount(best[0] - start, minlength=rows[-1] - start + 1)
            last = np.cumsum(held)[rows - start] - 1
            with np.errstate(invalid="ignore"):
                reach = 1.0 - best[2][np.maximum(last, 0)] - 2 * room
            full = (held[rows - start] == k) & np.isfinite(reach)
            least = np.where(full, np.maximum(least, reach.astype("float32")), least)
        found.append(best)
    return tuple(np.concatenate(x) for x in zip(*found))


def _nearest_in_block(k: int):
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [WS, "question_id", "document_id", "chunk_index", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        questions = np.stack(left["embedding"].to_numpy()).astype("float64")
        right = right.sort_values(["document_id", "chunk_index"], ignore_index=True)
        chunks = np.stack(right["embedding"].to_numpy()).astype("float64")
        with np.errstate(invalid="ignore", divide="ignore"):
            questions = questions / np.linalg.norm(questions, axis=1, keepdims=True)
            chunks = chunks / np.linalg.norm(chunks, axis=1, keepdims=True)
        question, place, distance = _nearest_rows(questions, chunks, k)
        return pd.DataFrame(
            {
                WS: left[WS].to_numpy()[question],
                "question_id": left["question_id"].to_numpy()[question],
                "document_id": right["document_id"].to_numpy()[place],
                "chunk_index": right["chunk_index"].to_numpy()[place],
                "distance": distance,
            }
        )

    return nearest


def nearest_chunks(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 3,
    chunk_block: int = CHUNK_BLOCK,
    question_block: int = QUESTION_BLOCK,
) -> DataFrame:
    """Exact k nearest chunks per question by cosine distance, within a workspace.

    Each workspace's questions and chunks are cut into blocks by hash, and every pair of
    blocks is one bounded task that keeps k rows per question; no pair of rows is ever
    shuffled. Distances count to twelve places, ties go by document and chunk, a zero vector
    has no distance (NULL) and comes last.
    """
    q = questions.select(WS, "question_id", "embedding")
    # fresh columns, so that both sides may come from one frame
    names = [WS, "document_id", "chunk_index", "embedding"]
    c = chunks.select(*[F.col(n).alias(n) for n in names])
    grid = stored(_blocks(q, question_block, "_nq").join(_blocks(c, chunk_block, "_nc"), WS), "search-grid")
    # the block grid depends on counts only, so both sides agree on it in any re-run
    q_grid = lookup_join(q, grid, [WS], ["question_id"], "inner").select(
        WS,
        "question_id",
        "embedding",
        F.pmod(F.xxhash64("question_id"), F.col("_nq")).cast("int").alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)).alias("_cb"),
    )
    c_grid = lookup_join(c, grid, [WS], ["document_id", "chunk_index"], "inner").select(
        WS,
        "document_id",
        "chunk_index",
        "embedding",
        F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_qb"),
        F.pmod(F.xxhash64("document_id", "chunk_index"), F.col("_nc")).cast("int").alias("_cb"),
    )
    types = {f.name: f.dataType.simpleString() for f in [*q.schema, *c.schema]}
    names = [WS, "question_id", "document_id", "chunk_index"]
    schema = ", ".join([f"{n} {types[n]}" for n in names] + ["distance double"])
    cell = [WS, "_qb", "_cb"]
    found = (
        q_grid.groupBy(*cell)
        .cogroup(c_grid.groupBy(*cell))
        .applyInPandas(_nearest_in_block(k), schema)
    )
    order = [F.col("distance").asc_nulls_last(), F.col("document_id"), F.col("chunk_index")]
    return top_k(found, [WS, "question_id"], order, k, "ord")


def citations(nearest: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Nearest chunks as evidence rows: label, detail, source."""
    # plain joins: the few winners stand in the plan once, so the search runs once
    found = nearest.join(chunks.select(WS, "document_id", "chunk_index", "content"), [WS, "document_id", "chunk_index"])
    titled = found.join(documents.select(WS, "document_id", "title"), [WS, "document_id"])
    return titled.select(
        WS,
        "question_id",
        "ord",
        F.concat(F.lit(V.CITATION_LABEL), "title").alias("label"),
        F.col("content").alias("detail"),
        F.col("title").alias("source"),
    )
