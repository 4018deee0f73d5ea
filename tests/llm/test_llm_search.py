"""Top-k search and packing against brute force."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import clashing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerspark.llm import packing, tokens, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k, is_query):
    whole = {}
    for vec_id, vec in rows:
        if vec_id is None or vec is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        whole.setdefault(vec_id, []).append([int(np.floor(64 * float(np.float32(x)))) for x in vec])
    out = set()
    for q, vecs in whole.items():
        if not is_query(q):
            continue
        scored = [
            (-sum(a * b for a, b in zip(vecs[0], other)), v)
            for v, others in whole.items()
            if v != q
            for other in others
        ]
        out |= {(q, rank, v, -s) for rank, (s, v) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("params", [{}, {"k": 3, "pivots": 5, "group_size": 7, "lane_size": 20}])
def test_top_k(spark, params):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(200, 260)]  # copies and ties
    rows += [(300 + i, [1e5 if j == i else 0.0 for j in range(8)]) for i in range(4)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8)]
    rows += [(480, [2.0, 1.0]), (500, []), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    chosen = topk.TopKParams(**params)
    found = topk.top_k(clashing(frame.drop("label")), F.col("vec_id") % 20 == 0, params=chosen)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()]
    padded = [(i, v + [0.0] * (8 - len(v)) if v is not None and len(v) < 8 and None not in v else v) for i, v in rows]
    expected = brute_top(padded, chosen.k, lambda q: q % 20 == 0)
    assert len(got) == len(set(got)) and set(got) == expected


def test_top_k_large_numbers_and_little_data(spark):
    rows = [(0, [1e14, 3.0]), (20, [1.0, 2.0]), (21, [-1e3, 1.0])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    found = topk.top_k(frame, F.col("vec_id") == 20).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == brute_top(rows, 20, lambda q: q == 20)
    alone = spark.createDataFrame([(20, [1.0], 0)], VECTORS)
    assert topk.top_k(alone, F.col("vec_id") == 20).collect() == []
    nothing = spark.createDataFrame([], VECTORS)
    assert topk.top_k(nothing, F.col("vec_id") == 20).collect() == []


def test_tokens_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = tokens.encoder()
    texts = [
        "", " ", "  two  blanks ", "a\n\nb", "line \n next", "\t\ttabs\tend\t ", "I'll we've 's 'S", "x<|endoftext|>y",
        "<|endoftext|> <|endoftext|>", "Größe 12½ ٣ 漢字かな 🙂🙂", "   wide", "a\x1c\x1db", "\r\n\r\nq", "#$%&&&  ---",
    ]
    draw = random.Random(2)
    signs = "ab Z9é漢\n\t\r '.-<|> \x1f "
    texts += ["".join(draw.choice(signs) for _ in range(draw.randrange(1, 60))) for _ in range(400)]
    assert [encode(t) for t in texts] == [
        e.ids for e in library.encode_batch(texts, add_special_tokens=False)
    ]


def test_pack(spark, awkward, no_docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    params = packing.PackParams(capacity=64, group_size=40)
    rows = awkward.select("text").collect() * 3
    docs = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "doc_id long, text string")
    packed = packing.pack(clashing(docs), params=params, with_ids=True)
    found = packed.collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for number, row in enumerate(rows):
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[number], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.length == 64 for r in own[1:]) and (len(own) == 1 or 0 < own[0].length <= 64)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in own)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:k]) for k in range(len(held))]
        assert sum(r.length for r in held) <= 64
    joined = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    assert joined == {s: [i for r in held for i in r.ids] for s, held in bins.items()}
    assert packing.pack(no_docs).count() == 0
    again = packing.pack(awkward).collect()
    assert len({r.row_id for r in again}) == awkward.count()


def test_search_empties_bins():
    # 8 and 6 change places, then the last piece fits
    params = packing.PackParams(capacity=20)
    lengths = [9, 8, 7, 6, 5, 5]
    bins = [[0, 1], [2, 3, 4], [5]]
    found = packing.local_search([list(b) for b in bins], lengths, params)
    assert len(found) == 2
    assert sorted(i for b in found for i in b) == list(range(6))
    assert all(sum(lengths[i] for i in b) <= 20 for b in found)


def test_packing_is_close_to_the_bound():
    draw = random.Random(5)
    params = packing.PackParams()
    for mean in (60, 300, 700):
        lengths = sorted((min(1023, 1 + int(draw.expovariate(1 / mean))) for _ in range(3000)), reverse=True)
        first = packing.best_fit(lengths, params.capacity)
        found = packing.local_search([list(b) for b in first], lengths, params)
        assert sorted(i for b in found for i in b) == list(range(3000))
        assert all(sum(lengths[i] for i in b) <= params.capacity for b in found)
        assert len(found) <= len(first)
        # pieces over half a sequence need one each
        bound = max(-(-sum(lengths) // params.capacity), sum(2 * n > params.capacity for n in lengths))
        assert len(found) <= 1.02 * bound + 1
