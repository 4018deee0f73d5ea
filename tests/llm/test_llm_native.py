"""Mixing, chat formatting and license scans against brute force and round trips."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from brute import ASCII, clashing
from pyspark.sql import functions as F

from ledgerspark.llm import chat, license_scan, mixing


def fill(sizes: dict, weights: dict, epochs: int) -> dict:
    """Water-filling by exact fractions, source by source."""
    target, free, left = {}, set(sizes), Fraction(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        above = {s for s in free if epochs * sizes[s] <= left * weights[s] / total}
        if not above:
            return target | {s: left * weights[s] / total for s in free}
        for s in above:
            target[s] = Fraction(epochs * sizes[s])
            left -= target[s]
        free -= above
    return target


def docs_of(spark, counts: dict):
    rows, number = [], 0
    for source, sizes in counts.items():
        for size in sizes:
            rows.append((number, " ".join(["w"] * size), source))
            number += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize(
    "counts",
    [
        {"a": [40] * 50, "b": [7, 9, 30] * 20, "c": [5] * 400, "d": [3], None: [10, 20]},
        {"a": [1], "b": [1000] * 30, "c": [2]},
        {"a": [0, 0], "b": [0]},
        {"x": [50, 5000, 3, 4, 9]},
    ],
)
def test_mix(spark, counts):
    docs = docs_of(spark, counts)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)
    sizes = {s: sum(v) for s, v in counts.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets = fill(sizes, weights, 3)
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(float(targets[r.source]))
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert taken[source] <= target
        missing = float(target - taken[source])
        assert missing < max([1, *counts[source]])


def test_mixed_rows(awkward, no_docs, spark):
    mixed = mixing.mixed_rows(clashing(awkward))
    assert mixed.columns == clashing(awkward).columns
    plan = Counter()
    for r in mixing.mix(awkward).collect():
        plan[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixed.collect()) == +plan
    assert mixing.mixed_rows(no_docs).count() == 0


def test_word_count(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0cd\re\n", "a b  c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in rows.select(mixing.word_count(F.col("text"))).collect()]
    assert found == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


TURNS = "conv_id long, turn long, role string, text string"
TRICKY = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|", "a<", "", None, "\\", "<<||>>", "\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate([*TRICKY, "end"])]
    rows += [(2, 0, "we\\n\nird<|", "x"), (2, 1, None, "y"), (2, None, "system", "z")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "v"), (3, 0, "user", "only")]
    rows += [(4, 0, "system", "s"), (4, 0, "assistant", "t"), (4, 1, "user", "u"), (4, 1, "user", "u")]
    output = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(3))
    found = {r.conv_id: r for r in chat.read_back(output).collect()}
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(said)
    for conv, turns in said.items():
        turns.sort()
        r = found[conv]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in turns]
        assert r.learned == "".join(x[3] for x in turns if x[2] == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == len(turns) == r.formatted.count("<|im_end|>")
    assert found[1].valid and found[None].valid
    assert (found[2].first_error, found[3].first_error, found[4].first_error) == (1, 1, 0)
    empty = chat.format_conversations(spark.createDataFrame([], TURNS))
    assert chat.read_back(empty).count() == 0


@pytest.mark.parametrize(
    ("roles", "error"),
    [
        ("user assistant", None),
        ("system user assistant user assistant", None),
        ("user assistant tool tool assistant", None),
        ("assistant user", 0),
        ("user user assistant", 1),
        ("user assistant system", 2),
        ("user assistant user", 3),
        ("system", 1),
        ("user robot", 1),
    ],
)
def test_chat_machine(spark, roles, error):
    rows = [(1, i, role, "x") for i, role in enumerate(roles.split())]
    found = chat.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert (found.valid, found.first_error) == (error is None, error)


def brute_scan(text):
    found = re.findall(license_scan.WORD, (text or "").translate(ASCII))
    hits = []
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        hits += [(i, label) for i in range(len(found)) if found[i : i + len(parts)] == parts]
    starts = [i for i, _ in hits]
    labels = ",".join(sorted({label for _, label in hits}))
    return len(found), len(hits), min(starts, default=None), max(starts, default=None), labels


def test_license_scan(spark, awkward, no_docs):
    notice = license_scan.NOTICES[1][0]
    gap = notice.replace("applicable law", "every applicable law").replace(" writing", "")
    half = " ".join(notice.split()[: len(notice.split()) // 2])
    texts = [
        "CC BY cc by-cc by, CC\nBY.",
        "All rights all rights reserved; All-Rights_Reserved all rights",
        "general public general public license" * 3,
        "Released under the MIT License.",
        f"x y {notice.upper()} z",
        f"before {gap} after",
        half,
        "cc é by ccby",
        "This work is licensed under the GNU General Public License, version 3.",
        "word " * 40_000 + "cc by",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.unionByName(docs.where("doc_id < 3")).repartition(4)
    found = defaultdict(list)
    for r in license_scan.scan_licenses(clashing(docs)).collect():
        found[r.doc_id].append(r)
    for number, text in enumerate(texts):
        assert len(found[number]) == (2 if number < 3 else 1)
        for r in found[number]:
            assert brute_scan(text) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
    labels = {n: rows[0].labels for n, rows in found.items()}
    assert labels[3] == "mit" and labels[4] == labels[5] == "apache-2.0" and labels[8] == "gpl,gpl-3"
    assert labels[6] == labels[7] == labels[10] == ""
    assert found[4][0].score == 1 and 0.8 <= found[5][0].score < 1 and found[6][0].score == 0
    assert license_scan.scan_licenses(awkward).count() == awkward.count()
    assert license_scan.scan_licenses(no_docs).count() == 0
