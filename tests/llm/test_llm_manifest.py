"""The manifest against a tree built row by row, and its versions against whole rebuilds."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from brute import ASCII, clashing
from pyspark.sql import functions as F

from ledgerspark.llm import manifest


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(row) -> str:
    parts = []
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = row[name]
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return digest("".join(parts))


def levels_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def siblings(levels: list[list[str]], at: int) -> str:
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out += level[start:at] + level[at + 1 : start + 8]
        at //= 8
    return "".join(out)


def expected(rows: list[dict]) -> Counter:
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf_of(r)))
    trees = {name: levels_of([leaf_of(r) for r in groups[name]]) for name in names}
    top = levels_of([trees[name][-1][0] for name in names])

    def root(name, at, leaf):
        nodes = list(trees[name][0])
        nodes[at] = leaf
        subroots = list(top[0])
        subroots[names.index(name)] = levels_of(nodes)[-1][0]
        return levels_of(subroots)[-1][0]

    out = Counter()
    for place, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            other = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"]:
                other["text"] = row["text"].translate(ASCII)
            folded = root(name, at, leaf_of(other))
            proof = digest(siblings(trees[name], at) + siblings(top, place))
            whole = top[-1][0]
            out[(row["doc_id"], leaf_of(row), trees[name][-1][0], whole, proof, folded, folded == whole)] += 1
    return out


def made(rows: int, langs: list) -> list[dict]:
    texts = ["Some Text", "lower only", None, "", "É Ü ß", "A"]
    return [
        {"doc_id": 7 * i % 1000, "text": texts[i % 6], "lang": langs[i * i % len(langs)], "source": None, "n_chars": i}
        for i in range(rows)
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("rows, langs", [(1, ["en"]), (9, [None, "en"]), (300, ["x", "ä", "", None, "Z"]), (150, ["a"])])
def test_small_trees(spark, levels, rows, langs):
    given = made(rows, langs)
    docs = spark.createDataFrame([tuple(r.values()) for r in given], SCHEMA)
    found = manifest.document_manifest(docs.repartition(3), levels=levels).collect()
    assert Counter(map(tuple, found)) == expected(given)


def test_many_groups(spark):
    given = made(200, [f"l{i}" for i in range(90)])
    docs = spark.createDataFrame([tuple(r.values()) for r in given], SCHEMA)
    assert Counter(map(tuple, manifest.document_manifest(docs).collect())) == expected(given)


def test_awkward_rows(spark, awkward):
    rows = [r.asDict() for r in awkward.collect()]
    found = manifest.document_manifest(clashing(awkward)).collect()
    assert Counter(map(tuple, found)) == expected(rows)


def test_no_rows(no_docs):
    assert manifest.document_manifest(no_docs).count() == 0


def test_a_version_copies_its_ancestors_only(spark):
    given = made(150, ["a", "b"])
    docs = spark.createDataFrame([tuple(r.values()) for r in given], SCHEMA)
    found = manifest.document_manifest(docs, changes=F.lit(True), copies=True).collect()
    for r in found:
        assert len(r.copies) == 4 and r.copies[-1] == r.folded_root
        assert (r.copies[2] == r.subroot) == r.verified


def test_one_text_in_a_third_of_the_rows(spark):
    given = [{"doc_id": 5, "text": "same", "lang": "en", "source": "s", "n_chars": 4}] * 200 + made(100, ["en", "de"])
    docs = spark.createDataFrame([tuple(r.values()) for r in given], SCHEMA)
    assert Counter(map(tuple, manifest.document_manifest(docs).collect())) == expected(given)
