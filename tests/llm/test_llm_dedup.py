"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import brute_components, clashing, shingles
from pyspark.sql import functions as F

from ledgerspark.llm import common, exact_dedup, near_dedup
from ledgerspark.llm.components import components
from ledgerspark.llm.shingles import factors


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return groups


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("rounds", [1, 3])
def test_exact_groups(awkward, keep, rounds):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    groups = brute_exact(rows)
    found = exact_dedup.exact_groups(awkward.repartition(7), keep=keep, rounds=rounds).collect()
    assert len(found) == len(rows)
    by_digest = defaultdict(list)
    for r in found:
        by_digest[r.text_sha256].append(r)
    for text, docs in groups.items():
        own = by_digest[hashlib.sha256(text.encode()).hexdigest()]
        ranked = sorted(docs, key=lambda d: (d is not None, d or 0))
        assert {r.keep_id for r in own} == {ranked[-1 if keep == "largest" else 0]}
        assert {r.group_size for r in own} == {len(docs)}
        assert sum(r.kept for r in own) == 1


def test_runs_are_merged_in_order(spark):
    """A round deals by ranges and sorts once; a hot text is one entry of each run."""
    rows = spark.range(4000).select(
        F.pmod("id", F.lit(8)).cast("int").alias("run"),
        F.col("id").alias("row_id"),
        F.col("id").alias("doc_id"),
        F.unhex(F.sha2(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")), 256)).alias("digest"),
        F.lit(3).alias("n_bytes"),
        F.lit(7).cast("long").alias("text_a"),
    )
    entries = exact_dedup.run_entries(rows, "largest")
    hot = entries.where("group_size > 1").collect()
    assert len(hot) == 8 and sum(r.group_size for r in hot) == 1334
    merged = exact_dedup.merge_runs(common.stored(entries, "entries"), 3, "largest")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Sort [") == 3
    assert "Exchange hashpartitioning" not in plan
    top = merged.orderBy(F.desc("group_size")).first()
    assert (top.group_size, top.best.doc_id) == (1334, 3999)
    assert merged.count() == 4000 - 1334 + 1


def test_drop_exact_keeps_columns(awkward, no_docs):
    kept = exact_dedup.drop_exact(clashing(awkward))
    assert kept.columns == clashing(awkward).columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in awkward.collect()})
    assert exact_dedup.drop_exact(no_docs).count() == 0


def corpus():
    """Chains and stars of edited copies, passages shared by many, short and blank texts."""
    draw = random.Random(4)

    def some(count):
        return [f"v{draw.randrange(500)}" for _ in range(count)]

    texts, passage = [], some(60)
    for _ in range(12):
        now = some(100)
        for _ in range(draw.randrange(1, 9)):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(draw.randrange(1, 4)):
                now[draw.randrange(len(now))] = f"e{draw.randrange(10_000)}"
    for _ in range(40):
        texts.append(" ".join(passage + some(draw.randrange(5, 60))))
    star = some(150)
    for _ in range(50):
        own = list(star)
        for at in draw.sample(range(150), 2):
            own[at] = f"s{draw.randrange(10_000)}"
        texts.append(" ".join(own))
    texts += ["", None, "  \n", "a b", "A B", "a b c", "a b c d", "a b c d e", texts[3], texts[3]]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size", [4, 5])
@pytest.mark.parametrize("block", [3, 2048])
def test_near_groups(spark, size, block):
    rows = corpus()
    params = near_dedup.NearParams(shingle=size, block=block, pivot_rounds=1 if block == 3 else 2)
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in near_dedup.near_groups(docs, params=params).collect()}
    sets = {d: shingles(t, size) for d, t in rows}
    label = brute_components(sets, 80)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in found.items()} == {
        d: (len(sets[d]), label[d], label[d] == d) for d, _ in rows
    }


def test_near_awkward(awkward, no_docs):
    found = near_dedup.near_groups(awkward).collect()
    assert len(found) == awkward.count()
    stays = [r for r in found if r.stays]
    assert {r.doc_id for r in stays} == {1, 5, 6, 7, 8, 10, 11, 12}
    assert [r.component_id for r in found if r.doc_id is None] == [1]
    kept = near_dedup.drop_near(clashing(awkward))
    assert kept.columns == clashing(awkward).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6, 7, 8, 10, 11, 12]
    assert near_dedup.near_groups(no_docs).count() == 0


def test_sketch_estimates_similarity():
    params = near_dedup.NearParams()
    draw = np.random.default_rng(3)
    multipliers = factors(params.samples, params.seed)
    for share in (0.7, 0.8, 0.9, 0.97):
        sides = []
        common = draw.integers(0, 2**63, 1000, dtype=np.uint64)
        own = int(1000 * (1 - share) / share / 2)
        for _ in range(2):
            extra = draw.integers(0, 2**63, own, dtype=np.uint64)
            sides.append(near_dedup.minhashes(np.concatenate([common, extra]), multipliers))
        odd = near_dedup.odd_sketches(np.stack(sides), params.bits).view(np.uint64)
        apart = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        estimate = 1 + params.bits / (4 * params.samples) * np.log(1 - 2 * apart / params.bits)
        assert abs(estimate - share) < 0.08
        assert apart <= params.max_differing or share < 0.75


def test_components(spark):
    draw = random.Random(8)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)]
    links += [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    expected = {x: root(x) for x in parent if root(x) != x}
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.a: r.b for r in found.collect()} == expected
    nothing = components(spark.createDataFrame([], "a long, b long"))
    assert nothing.select(F.count("*")).first()[0] == 0


def test_key_test_lets_every_key_through(spark):
    keys = spark.range(5000).selectExpr("if(id % 50 = 0, null, id * 7) as a", "concat('k', id) as b")
    others = spark.range(20000).selectExpr("id * 7 + 1 as a", "concat('n', id) as b")
    test = common.may_hold(keys, ["a", "b"])
    hit = test([F.col("a"), F.col("b")])
    assert keys.where(hit).count() == 5000
    assert others.where(hit).count() < 2000
    none = common.may_hold(keys.limit(0), ["a", "b"])
    assert others.where(none([F.col("a"), F.col("b")])).count() == 0
