"""BPE ids against the tiktoken library, and back to the bytes."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    None,
    "",
    " ",
    "   \t\n  x  ",
    "it's we'll I'd they've 'S 're  'm",
    "'' ' 'q ''ll",
    "漢字かな交じり文 한국어 русский текст العربية हिन्दी",
    "🚴🏽‍♀️ emoji 👩‍👩‍👧 and 𝔘𝔫𝔦𝔠𝔬𝔡𝔢 𐍈 𠀀𠀁",
    "é ​   　 \x85 \xa0 \x1c\x1d \x00 ﻿",
    "1234567890 ½ Ⅻ ٣ ²",
    "՘ ࢏ ꟝ \U0003fc3b \U00011de3 ࢗ",
    "<|endoftext|> <|im_start|>",
    "x" * 50_000,
    " " * 50_000 + "y",
    "-=" * 30_000,
]


def test_tables(codec):
    entries = codec.entries
    assert codec.hash.candidates(entries).tolist() == list(range(len(entries)))
    strangers = [b"", b"zzzzqqq", *[e + b"\x00\xff" for e in entries[:2000]]]
    near = codec.hash.candidates(strangers)
    assert ((near >= 0) & (near < len(entries))).all()
    assert sorted(codec.hash.key_at.tolist()) == list(range(len(entries)))


def test_every_code_point(codec, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "1".join(points[i : i + 997]) + " b" for i in range(0, len(points), 997)]
    flat, sizes = codec.encode(texts)
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert flat[at : at + size].tolist() == library.encode_ordinary(text)
        at += size


def test_merges(codec, library):
    draw = random.Random(5)
    for _ in range(3000):
        piece = bytes(draw.choice(b"abcdeotnrsi \xc3\xa9\xff") for _ in range(draw.randrange(2, 30)))
        assert bpe.merged(piece, codec.ranks) == library._core_bpe.encode_single_piece(piece)


def test_small_memory_gives_the_same_ids(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 50)
    monkeypatch.setattr(bpe, "MEMORY", 20)
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["alpha", "beta", "gam'll", "δέλτα", "12"]) for _ in range(90)) for _ in range(30)]
    flat, sizes = codec.encode(texts)
    assert flat.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert sizes.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_columns(spark, codec, library, awkward):
    rows = [(i, t, "kept", i) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None), (None, "no id", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded long")
    made = bpe.encode(docs, codec=codec)
    assert made.columns == ["doc_id", "ids", "decoded", "ids_"]
    back = bpe.decode(made.withColumn("list", F.col("ids_")), ids="ids_", codec=codec)
    assert back.columns == ["doc_id", "ids", "decoded", "list", "decoded_"]
    found = sorted(repr((r.doc_id, r.ids, r.decoded, r.list, bytes(r.decoded_))) for r in back.collect())
    want = [(i, a, b, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, a, b in rows]
    assert found == sorted(map(repr, want))
    assert bpe.encode(awkward, codec=codec).count() == awkward.count()


def test_nulls_and_no_rows(spark, no_docs, codec):
    assert bpe.encode(no_docs, codec=codec).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(none, codec=codec).first().decoded) == b""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark, library):
    found = {r.doc_id: tuple(r)[1:] for r in queries.op12_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        assert found[r.doc_id] == (len(ids), *digests)
