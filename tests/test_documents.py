"""Chunk tables and nearest chunks against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hall import STAMP, d

from ledgerspark import schemas
from ledgerspark.operators import documents as D
from ledgerspark.operators import merges, nearest
from ledgerspark.plans import chunk_index


def test_nearest_chunks_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    questions, chunks = [], []
    for ws, (n_q, n_c) in {"hot": (25, 180), "b": (3, 2), "only_questions": (2, 0)}.items():
        for i in range(n_q):
            questions.append((ws, f"q{i}", rng.integers(-3, 4, 4).astype(float).tolist()))
        for i in range(n_c):
            chunks.append((ws, f"d{i % 20:02}", i // 20, rng.integers(-3, 4, 4).astype(float).tolist()))
    questions.append(("b", "zero", [0.0] * 4))
    left = spark.createDataFrame(questions, "workspace_id string, question_id string, embedding array<double>")
    right = spark.createDataFrame(
        chunks, "workspace_id string, document_id string, chunk_index int, embedding array<double>"
    )
    expected = set()
    for ws, q, v in questions:
        near = []
        for cws, doc, i, u in chunks:
            if cws == ws:
                norm = np.linalg.norm(v) * np.linalg.norm(u)
                distance = round(1 - float(np.dot(v, u)) / norm, 6) if norm else float("inf")
                near.append((distance, doc, i))
        for n, (_, doc, i) in enumerate(sorted(near)[:3], 1):
            expected.add((ws, q, doc, i, n))
    for blocks in [(7, 4), (100000, 100000)]:
        found = D.nearest_chunks(left, right, 3, *blocks).collect()
        rows = {(r.workspace_id, r.question_id, r.document_id, r.chunk_index, r.ord) for r in found}
        assert len(rows) == len(found)
        assert rows == expected


def test_document_merge_and_chunk_replacement(spark):
    def doc(i, title, summary, kind="note"):
        return ("w", i, title, kind, summary, d("2026-05-01"), STAMP)

    stored = spark.createDataFrame([doc("1", "a", "x " * 300), doc("2", "b", "short")], schemas.DOCUMENTS)
    batch = spark.createDataFrame([doc("9", "a", "new", "bill"), doc("3", "c", "third")], schemas.DOCUMENTS)
    merged = merges.upsert_documents(stored, batch, ["document_id"])
    found = {r.document_id: (r.kind, r.summary[:5]) for r in merged.collect()}
    assert found == {"1": ("bill", "new"), "2": ("note", "short"), "3": ("note", "third")}
    changed = merged.filter("document_id in ('1', '3')")
    chunks = merges.replace_chunks(D.index_chunks(stored), changed, D.index_chunks(changed))
    rows = sorted((r.document_id, r.chunk_index, r.content) for r in chunks.collect())
    assert rows == [("1", 0, "new"), ("2", 0, "short"), ("3", 0, "third")]
    assert all(len(r.embedding) == 24 for r in chunks.collect())


def test_a_frame_may_search_itself(spark):
    rows = spark.createDataFrame([("w", "a", [1.0, 0.0]), ("w", "b", [1.0, 0.1])], "workspace_id string, id string, embedding array<double>")
    stored = rows.withColumnRenamed("id", "document_id").selectExpr("*", "0 as chunk_index")
    found = D.nearest_chunks(rows.withColumnRenamed("id", "question_id"), stored, 1).collect()
    assert {(r.question_id, r.document_id) for r in found} == {("a", "a"), ("b", "b")}


def test_kept_index_embeds_changed_documents_only(spark, tmp_path):
    def docs(*rows):
        return spark.createDataFrame(
            [("w", i, i, "k", summary, d("2031-01-01"), STAMP) for i, summary in rows], schemas.DOCUMENTS
        )

    root, long = str(tmp_path / "index"), "word " * 200
    assert chunk_index.refresh_index(spark, root, docs(("1", long), ("2", "two"), ("3", None))) == 1
    after = docs(("1", long), ("2", "two again"), ("4", "new"))
    assert chunk_index.refresh_index(spark, root, after) == 2
    assert chunk_index.refresh_index(spark, root, after) == 3
    made = spark.read.parquet(f"{root}/chunks").groupBy("batch_id", "document_id").count().collect()
    assert sorted(tuple(r) for r in made) == [("run-1", "1", 4), ("run-1", "2", 1), ("run-2", "2", 1), ("run-2", "4", 1)]
    key = ["workspace_id", "document_id", "chunk_index"]
    kept = chunk_index.read_index(spark, root).orderBy(*key).collect()
    assert kept == D.index_chunks(after).orderBy(*key).collect()


def _vectors(spark, rows, names):
    return spark.createDataFrame(rows, f"workspace_id string, {names}, embedding array<double>")


def _clouds(spark, spread):
    """Questions and chunks around six directions; a hot workspace, vectors without direction, ties, NULLs."""
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(6, 8))

    def near(n):
        return (middles[n % 6] + spread * rng.normal(size=8)).tolist()

    questions = [("hot", f"q{i}", near(i)) for i in range(40)] + [("few", "q", near(0)), ("none", "q", near(1))]
    questions += [("hot", "zero", [0.0] * 8), ("hot", "null", None), ("zeros", "q", near(2))]
    chunks = [("hot", f"d{i % 30:02}", i // 30, near(i)) for i in range(300)]
    chunks += [("hot", f"e{i}", 0, middles[3].tolist()) for i in range(9)]
    chunks += [("hot", "null", 0, None), ("hot", "zero", 0, [0.0] * 8), ("few", "a", 0, near(4)), ("few", "b", 0, [0.0] * 8)]
    chunks += [("zeros", f"z{i}", 0, [0.0] * 8) for i in range(5)]
    return (
        _vectors(spark, questions, "question_id string"),
        _vectors(spark, chunks, "document_id string, chunk_index int"),
    )


@pytest.mark.parametrize("spread", [0.05, 3.0])
@pytest.mark.parametrize("sizes", [(8, 20, 7), (32, 100_000, 1024), (1, 50, 1024)])
def test_skipped_blocks_hold_no_nearer_chunk(spark, spread, sizes):
    pivots, block, question_block = sizes
    questions, chunks = _clouds(spark, spread)
    blocked, blocks = nearest.block_chunks(chunks, pivots, block)
    assert blocks.agg({"chunks": "sum"}).first()[0] == blocked.count() == 300 + 9 + 1 + 2 + 5
    found, report = nearest.nearest_in_blocks(questions, blocked, blocks, 3, question_block)
    usable = "embedding is not null"
    whole = D.nearest_chunks(questions.filter(usable), chunks.filter(usable), 3)
    key = ["workspace_id", "question_id", "ord"]
    columns = [*key, "document_id", "chunk_index", "distance"]
    assert [str(r) for r in found.select(*columns).orderBy(*key).collect()] == [
        str(r) for r in whole.select(*columns).orderBy(*key).collect()
    ]
    few = [(r.document_id, r.distance is None) for r in found.filter("workspace_id = 'few'").orderBy("ord").collect()]
    assert few == [("a", False), ("b", True)]
    hot = report.filter("workspace_id = 'hot'").first()
    assert hot.asked == 41 and hot.compared + hot.skipped == 41 * hot.blocks
    if spread < 1 and pivots > 1:
        assert hot.skipped > hot.compared


def test_blocks_of_an_empty_table(spark):
    questions, chunks = _clouds(spark, 1.0)
    found, report = nearest.nearest_in_blocks(questions, *nearest.block_chunks(chunks.limit(0)), 3)
    assert found.count() == report.count() == 0
    found, report = nearest.nearest_in_blocks(questions.limit(0), *nearest.block_chunks(chunks), 3)
    assert found.count() == report.count() == 0


def test_few_pairs_are_compared_in_full(spark, monkeypatch):
    """Of 300 x 9,000 pairs next to none reaches double precision, and the result is that of comparing all."""
    rng = np.random.default_rng(5)
    questions, chunks = rng.normal(size=(300, 8)), rng.normal(size=(9000, 8))
    chunks[3000:6000] = chunks[17]
    questions /= np.linalg.norm(questions, axis=1, keepdims=True)
    chunks /= np.linalg.norm(chunks, axis=1, keepdims=True)
    chunks[50], questions[7] = np.nan, np.nan
    compared, plain = [], D._compared
    monkeypatch.setattr(D, "_compared", lambda *a: compared.append(len(a[2])) or plain(*a))
    question, place, distance = D._nearest_rows(questions, chunks, 3)
    whole = np.round(1.0 - questions @ chunks.T, 12)
    order = np.argsort(whole, axis=1, kind="stable")[:, :3]
    found = {(q, p) for q, p in zip(question.tolist(), place.tolist())}
    assert found == {(q, p) for q, row in enumerate(order.tolist()) for p in row}
    assert len(found) == len(question) == 900 and np.isnan(distance).sum() == 3
    assert sum(compared) < 0.01 * whole.size


def test_vectors_are_shuffled_once_for_a_search(spark):
    questions, chunks = _clouds(spark, 0.5)
    plan = D.nearest_chunks(questions, chunks, 3)._jdf.queryExecution().executedPlan().toString()
    # questions and chunks by cell, and what was found by question
    assert plan.count("Exchange hashpartitioning") == 3


def test_vectors_are_shuffled_once_for_each_search_of_blocks(spark, monkeypatch):
    questions, chunks = _clouds(spark, 0.5)
    blocked = nearest.block_chunks(chunks)
    plans, plain = [], nearest.stored

    def kept(frame, name):
        if name == "block-nearest":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return plain(frame, name)

    monkeypatch.setattr(nearest, "stored", kept)
    nearest.nearest_in_blocks(questions, *blocked, 3)
    # visits and chunks by cell, in the first and in the further search
    assert [plan.count("Exchange hashpartitioning") for plan in plans] == [2, 2]
