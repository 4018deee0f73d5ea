"""Trained operators: held-out accuracy on the driver's tables, exactness, awkward input."""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import clashing
from pyspark.sql import functions as F

from ledgerspark.llm import language, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_language_by_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taught = docs.where("doc_id % 2 = 0")
    model = language.train(taught, "doc_id", "text", "lang")
    judged = language.identify(docs.where("doc_id % 2 = 1"), model)
    told = judged.join(docs, "doc_id")
    right, rows = told.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right > 0.98 and rows == docs.where("doc_id % 2 = 1").count()


@tables
def test_page_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = language.page_evidence(spark.read.parquet(f"{SF}/pages.parquet"))
    model = language.train(docs, "doc_id", "text", "lang")
    judged = language.identify(
        pages, model, doc_id="page_id", declared="declared", host="host", suffix="suffix"
    )
    told = judged.join(pages.select("page_id", "declared"), judged["doc_id"] == F.col("page_id"))
    assert told.agg(F.avg((F.col("language") == F.col("declared")).cast("int"))).first()[0] > 0.9


def test_evidence_decides_where_text_does_not(spark):
    taught = [(i, "the cat and the dog of the house xyz", "en") for i in range(5)]
    taught += [(10 + i, "der hund und die katze des hauses xyz", "de") for i in range(5)]
    schema = "doc_id long, text string, lang string"
    model = language.train(spark.createDataFrame(taught, schema), "doc_id", "text", "lang")
    rows = [(i, "the cat and the dog", "en", "h1", "uk") for i in range(30)]
    rows += [(100 + i, "der hund und die katze", "de-AT", "h2", "at") for i in range(30)]
    rows += [(200, "xyz", None, "h1", "uk"), (201, "xyz", None, "h2", "at")]
    rows += [(202, "xyz", "de", "new", "at"), (203, "xyz", "EN-us", None, None)]
    rows += [(204, "漢字 かな 交じり文 " * 9, "en", "h1", "uk"), (205, None, "en", "h1", "uk"), (206, "12 !", "en", "h1", "uk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    options = {"declared": "declared", "host": "host", "suffix": "suffix"}
    judged = {r.doc_id: r for r in language.identify(docs, model, **options).collect()}
    assert [judged[i].language for i in (200, 201, 202, 203)] == ["en", "de", "de", "en"]
    assert [judged[i].language for i in (204, 205, 206)] == ["und"] * 3
    kept = language.keep_identified(clashing(docs), model, **options)
    assert kept.columns == clashing(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}
    assert not {204, 205, 206} & {i for i, r in judged.items() if r.kept}


def test_rare_language_is_known(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(4000)]
    rows += [(5000 + i, "der hund und die katze", "de") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, "doc_id", "text", "lang", language.LanguageParams(sample=100))
    assert model.languages == ("de", "en")
    judged = language.identify(docs.where("doc_id >= 5000"), model).collect()
    assert [r.language for r in judged] == ["de"] * 4


def test_language_awkward(awkward, no_docs):
    model = language.train(awkward, "doc_id", "text", "lang")
    assert model.languages == ("en",)
    judged = language.identify(awkward, model, declared="lang", host="source").collect()
    assert len(judged) == awkward.count()
    assert all(0 <= r.probability <= 1 for r in judged)
    assert language.identify(no_docs, model, declared="lang", host="source").count() == 0
    empty = language.train(no_docs, "doc_id", "text", "lang")
    assert {r.language for r in language.identify(awkward, empty).collect()} == {"und"}


@tables
def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("grade", F.col("quality"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    told = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    same = (F.col("kept").cast("int") == F.col("quality")).cast("int")
    assert told.agg(F.avg(same)).first()[0] > 0.93


def test_ordinal_fit_finds_order():
    params = quality.QualityParams(steps=400)
    draw = np.random.default_rng(6)
    true = np.array([2.0, -2.0, 0.0])
    rows = []
    for _ in range(1500):
        value = draw.normal(size=3)
        line = value @ true + draw.logistic()
        rows.append((int((line > -1).sum() + (line > 1.5).sum()) * 5, np.arange(3), value.astype(np.float32)))
    model = quality.fit_ordinal(rows, params)
    assert model.grades == (0, 5, 10)
    assert model.thresholds[0] == pytest.approx(-1, abs=0.3)
    assert model.thresholds[1] == pytest.approx(1.5, abs=0.3)
    assert model.weights[:3] == pytest.approx(true, abs=0.35)


def test_quality_awkward(spark, awkward, no_docs):
    ratings = spark.createDataFrame(
        [(1, 2), (2, 0), (2, 1), (5, 1), (None, 1), (8, None), (77, 1), (10, 2)], "doc_id long, grade int"
    )
    model = quality.train(clashing(awkward), ratings)
    assert model.grades == (0, 1, 2) and list(model.thresholds) == sorted(model.thresholds)
    scored = quality.score(clashing(awkward), model).collect()
    assert len(scored) == awkward.count()
    for r in scored:
        assert len(r.tails) == 2 and 1 >= r.tails[0] >= r.tails[1] >= 0
        assert r.expected_grade == pytest.approx(sum(r.tails))
    assert quality.score(no_docs, model).count() == 0
    none = quality.train(awkward, ratings.where("grade > 9"))
    assert {(r.expected_grade, r.kept) for r in quality.score(awkward, none).collect()} == {(0.0, True)}


def test_quality_without_some_grades(spark, tmp_path):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "zq zq 9") for i in range(60)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for name, told in {"0 and 2": (0, 2), "1 and 2": (1, 2), "0 and 1": (0, 1), "2": (2, 2)}.items():
        # the query's grades: quality 0 is grade 0, toxic 1 is grade 1, else grade 2
        rows = [(i, int(told[i % 2] > 0), int(told[i % 2] == 1)) for i in range(60)]
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        labels.write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        found[name] = {r.doc_id: r for r in queries.op3_quality(spark, str(tmp_path)).collect()}
    assert all(r.kept == (i % 2 == 1) and r.p_good == r.p_best for i, r in found["0 and 2"].items())
    assert all(r.kept and r.p_good == 1 and (r.p_best > 0.5) == (i % 2 == 1) for i, r in found["1 and 2"].items())
    assert all(r.kept == (i % 2 == 1) and r.p_best == 0 for i, r in found["0 and 1"].items())
    assert all(r.kept and r.p_good == r.p_best == 1 for r in found["2"].values())


def test_quality_samples_rare_grades(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7}") for i in range(2000)], "doc_id long, text string")
    ratings = docs.selectExpr("doc_id", "case when doc_id = 77 then 1 else cast(doc_id % 2 as int) * 2 end as grade")
    model = quality.train(docs, ratings, params=quality.QualityParams(sample=90))
    assert model.grades == (0, 1, 2)


@tables
def test_toxicity_held_out(spark):
    told = queries.op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = told.where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in told.collect())
    right = sum((r.toxic == 1) == (r.predicted == 1) for r in rows)
    assert right / len(rows) > 0.9
    toxic = [r.score for r in rows if r.toxic]
    other = [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other)
    assert wins / (len(toxic) * len(other)) > 0.85


def test_block_max_search_is_exact():
    draw = np.random.default_rng(9)
    vectors = []
    for _ in range(300):
        places = sorted(draw.choice(40, draw.integers(0, 6), replace=False).tolist())
        vectors.append((places, toxicity.weighed(places, [1 + int(p) % 3 for p in places], np.linspace(1, 3, 40))))
    ids = np.arange(300)[::-1].copy()
    index = toxicity.BlockMaxIndex(ids, np.zeros(300, int), vectors, 40, 16)
    dense = np.zeros((300, 40))
    for at, (places, values) in enumerate(vectors):
        dense[at, places] = values
    for at, (places, values) in enumerate(vectors):
        sims = np.round(dense @ dense[at], 9)
        sims[at] = 0
        best = [i for i in np.lexsort((ids, -sims)) if sims[i] > 0][:10]
        numbers, found = index.search(places, values, 10, without=at)
        assert numbers.tolist() == best
        assert found == pytest.approx(sims[best], abs=1e-9)


def test_calibration_rises():
    draw = np.random.default_rng(2)
    raw = draw.random(400).round(2)
    label = (draw.random(400) < raw).astype(float)
    steps = toxicity.calibrated(raw, label, np.ones(400))
    assert steps == sorted(steps) and [s for _, s in steps] == sorted(s for _, s in steps)
    assert all(0 <= s <= 1 for _, s in steps)


def test_toxicity_awkward(spark, awkward, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (3, 1), (4, 1), (8, 0), (8, None), (10, 0), (None, 1), (11, 0), (99, 1)],
        "doc_id long, toxic int",
    )
    judged = toxicity.judge(clashing(awkward), labels).collect()
    assert len(judged) == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in judged)
    assert toxicity.judge(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.judge(awkward, labels.limit(0)).collect()} == {0.0}


def test_toxicity_counts_the_whole_text(spark):
    """Similarities against brute force; a chance hit in a long clean text is no likeness."""
    draw = np.random.default_rng(4)
    clean = [" ".join(f"clean{draw.integers(300)}" for _ in range(40)) for _ in range(12)] * 3
    texts = {i: text + (" vilest" if i < 12 else "") for i, text in enumerate(clean)}
    texts |= {90: "vilest", 91: " ".join(clean) + " vilest", 92: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(36)], "doc_id long, toxic int")
    terms = {i: toxicity.term_counts((text or "").encode()) for i, text in texts.items()}
    often = Counter(term for found in terms.values() for term in found)

    def vector(i):
        whole = {t: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + often[t])) + 1) for t, n in terms[i].items()}
        return {t: w / np.linalg.norm(list(whole.values())) for t, w in whole.items()}

    telling = [b"vilest", b"vile*", b"viles*"]
    for common in (None, 20):
        params = toxicity.ToxicParams(common_terms=common) if common else None
        judged = toxicity.judge(docs, labels, params=params).collect()
        found = {r.doc_id: r for r in judged}
        for i in (3, 90, 91):
            own = vector(i)
            alike = {j: sum(own[t] * vector(j)[t] for t in telling) for j in range(12) if j != i}
            assert dict(zip(found[i].neighbours, found[i].similarities)) == pytest.approx(alike, abs=1e-8)
        assert max(found[91].similarities) < 0.1 < max(found[90].similarities)
        assert found[92].neighbours == found[25].neighbours == []


def test_toxicity_compares_all_telling_terms(spark):
    """A text whose only telling term comes after 450 stronger ones has neighbours."""
    draw = np.random.default_rng(6)
    strong = " ".join(f"q{i:03d}" for i in range(450))
    texts = {i: " ".join(f"c{draw.integers(90)}" for _ in range(20)) for i in range(60)}
    texts |= {i: f"{texts[i]} {strong}" + (" weak" if i < 8 else "") for i in range(30)} | {90: "weak", 91: "q449"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert set(found[90].neighbours) == set(range(8))
    assert set(found[91].neighbours) <= set(range(30)) and len(found[91].neighbours) >= 15
    assert found[90].score > found[40].score


def test_neighbours_that_vote_are_chosen():
    """The fewest that are no worse on the examples than the best, within its error."""
    draw = np.random.default_rng(5)
    examples = []
    for at in range(400):
        toxic = int(at < 200)
        # place 0 tells truly; the others are chance terms that toxic examples share with clean ones
        places = ([0] if toxic else []) + [1 + at % 10]
        examples.append((at, toxic, at, 0, places, [1] * len(places), float(2 + draw.random() if toxic else 1.5)))
    params = toxicity.ToxicParams(neighbours=(15, 150))
    idf = np.array([1.0] + [2.0] * 10)
    model = toxicity._model(examples, [b"t"] * 11, idf, {0: 200, 1: 200}, params)
    raw = {}
    for k in params.neighbours:
        near = [model.index.search(*model.index.vectors[at], k, np.array([at])) for at in range(400)]
        votes = np.array([model.vote(*one, params) for one in near])
        label = model.index.labels
        steps = toxicity.calibrated(votes, label, np.ones(400))
        raw[k] = toxicity._log_loss(steps, votes, label, np.ones(400))
    least, error = min(raw.values())
    assert model.neighbours == min(k for k, (loss, _) in raw.items() if loss <= least + error)
    loss, error = toxicity._log_loss([(0.0, 0.2), (0.5, 1.0)], np.array([0.1, 0.5, 0.9]), np.array([0, 1, 1]), np.array([2.0, 1, 1]))
    want = np.array([-np.log(0.8), -np.log(0.999), -np.log(0.999)])
    mean = (2 * want[0] + want[1] + want[2]) / 4
    assert (loss, error) == pytest.approx((mean, np.sqrt((2 * (want[0] - mean)) ** 2 + 2 * (want[1] - mean) ** 2) / 4))


def test_equal_texts_score_equally(spark):
    draw = np.random.default_rng(8)
    texts = {i: " ".join(f"w{draw.integers(60)}" for _ in range(30)) + (" vile nasty" if i < 20 else "") for i in range(60)}
    texts |= {100 + i: texts[i] for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    found = {r.doc_id: (r.score, r.similarities) for r in toxicity.judge(docs, labels).collect()}
    assert all(found[i] == found[100 + i] for i in range(60))


def test_samples_hold_one_row_of_an_id(spark):
    docs = [(7, f"good word{i}") for i in range(300)] + [(i, f"{'vile' if i % 2 else 'good'} word{i}") for i in range(100, 400)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 130)], "doc_id long, toxic int")
    model, _ = toxicity.train(docs, labels, params=toxicity.ToxicParams(examples=10))
    assert len(model.index.ids) == len(set(model.index.ids.tolist())) <= 20
    seen = []
    fit = quality.fit_ordinal
    try:
        quality.fit_ordinal = lambda rows, *rest: seen.append(len(rows)) or fit(rows, *rest)
        quality.train(docs, labels.withColumnRenamed("toxic", "grade"), params=quality.QualityParams(sample=24))
    finally:
        quality.fit_ordinal = fit
    assert seen[0] <= 24


def test_hashed_terms_equal_plain_counts():
    texts = ["Words words WORDS wordy, éclair éclairs éclairage x".encode(), b"", "漢字漢字漢字漢字 漢字漢字漢字x".encode(), b"a b a"]
    owner, term, often, terms = toxicity._hashed(texts)
    found = sorted(zip(owner.tolist(), terms[term].tolist(), often.tolist()))
    want = [
        (at, int(np.uint64(toxicity.xxh3_64_intdigest(t)).view(np.int64)), n)
        for at, text in enumerate(texts)
        for t, n in toxicity.term_counts(text).items()
    ]
    assert found == sorted(want)
    owner, *_ = toxicity._hashed(texts, lambda word: word == b"b")
    assert set(owner.tolist()) == {3}
    assert [len(x) for x in toxicity._hashed([])] == [0, 0, 0, 0]


def test_hashed_terms_of_words_met_before():
    texts = [b"one seven eleven", b"eleven elevenses one", b"", "seven éclairs sevens".encode(), b"one one seventh"]
    known = toxicity._Met()
    for start in range(0, 5, 2):
        part = texts[start : start + 2]
        kept, fresh = toxicity._hashed(part, known=known), toxicity._hashed(part)
        plain = [sorted(zip(owner.tolist(), terms[term].tolist(), often.tolist())) for owner, term, often, terms in (kept, fresh)]
        assert plain[0] == plain[1]
    assert len(known.given) == len(known.words) and len(known.hashes) == len(known.numbers)


def test_junk_tags_make_no_languages(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der hund und", "de") for i in range(20)]
    rows += [(1000 + 3 * i + j, f"junk{i}", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(6000) for j in range(3)]
    rows += [(50000 + i, "some text", "english") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, "doc_id", "text", "lang", language.LanguageParams(languages=5))
    assert len(model.languages) == 5 and {"de", "en"} < set(model.languages)
    assert model.log_odds.shape == (5, 1 << 16)


def test_fusion_equals_brute_force(spark):
    """Posteriors of small documents, recomputed evidence by evidence."""
    taught = [(i, "the cat and the dog of the house", "en") for i in range(5)]
    taught += [(10 + i, "der hund und die katze des hauses", "de") for i in range(5)]
    model = language.train(spark.createDataFrame(taught, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    params = language.LanguageParams()
    texts = ["the cat", "der hund", "xyz and", "katze of", "hauses the dog der", "q"]
    hosts, suffixes, tags = ["h1", "h2", None, "h3"], ["uk", "at", None], ["en-GB", "de", None, "fr"]
    rows = [(i, texts[i % 6], hosts[i % 4], suffixes[i % 3], tags[i * 7 % 4]) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    found = language.identify(docs, model, declared="declared", host="host", suffix="suffix").collect()

    logs = []
    for _, text, *_ in rows:
        at = language.trigrams(text.encode(), params.buckets)
        own = [float(model.log_odds[k][at].astype(float).sum()) for k in range(2)]
        logs.append(params.trigram_weight * np.array([*own, -len(at) * np.log(params.buckets)]))
    logs = np.array(logs)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    overall = (p.sum(axis=0) + 1) / (p.sum() + 3)

    def total(column, row):
        return sum(p[i] for i, r in enumerate(rows) if r[column] == row[column])

    tag = [(r[4] or "")[:2] for r in rows]
    for i, row in enumerate(rows):
        prior = overall
        if row[3]:
            own = total(3, row)
            prior = (own + params.suffix_strength * prior) / (own.sum() + params.suffix_strength)
        if row[2]:
            own = np.maximum(total(2, row) - p[i], 0)
            prior = (own + params.host_strength * prior) / (own.sum() + params.host_strength)
        line = logs[i] + np.log(prior)
        if tag[i]:
            same = np.maximum(sum(p[j] for j in range(24) if tag[j] == tag[i]) - p[i], 0)
            line = line + np.log((same + params.declared_smoothing) / (p.sum(axis=0) + 3 * params.declared_smoothing))
        posterior = np.exp(line - line.max())
        posterior /= posterior.sum()
        judged = next(r for r in found if r.doc_id == i)
        assert judged.probability == pytest.approx(posterior.max(), rel=1e-6)
        assert judged.language == [*model.languages, "und"][int(posterior.argmax())]
