"""Toxicity by nearest labelled examples under TF-IDF cosine over telling terms.

Terms are words and the first four and five characters of longer words. A bounded sample of
labelled rows gives the terms that tell the classes apart, however many, and the examples. Telling terms
are compared, and every text has the length that all its terms give it, with their frequencies over
all documents (terms are told by 64-bit hashes): a chance hit in a long text counts little. One
pass over the texts counts frequencies, a second one finds the vectors. The examples stand in an inverted index cut into blocks with the largest
weight of each term, so a search skips every block whose bound cannot reach the k-th
neighbour and is exact all the same. Neighbours vote by similarity. How many vote is chosen
(the fewest that are no worse within the error), and the votes are calibrated, on the examples
themselves, each searched without its own text; the votes come with their evidence.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ledgerspark.llm.common import stored, text_key
from ledgerspark.llm.shingles import texts_of


@dataclass(frozen=True)
class ToxicParams:
    examples: int = 2_000  # of each class, at most
    least_rows: int = 3  # examples a term must stand in
    least_gain: float = 6.0  # log-likelihood ratio a term must reach
    neighbours: tuple[int, ...] = (15, 50, 200)  # how many may vote; the examples tell which is best
    block: int = 256
    common_terms: int = 4_000_000  # terms whose frequency every task holds, at most
    prior_votes: float = 0.5  # similarity that the base rate counts for
    threshold: float = 0.3


#: Fixed value: A-Z lowered, other ASCII that is no letter or digit a blank.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32
    for b in range(256)
)


def term_counts(text: bytes) -> Counter:
    """Counts of words and word beginnings; a beginning is cut by characters, not bytes."""
    counts: Counter = Counter()
    for word, n in Counter(text.translate(_WORDS).split()).items():
        counts[word] += n
        if len(word) > 4:
            letters = word.decode("utf-8", "replace")
            for length in (4, 5):
                if len(letters) > length:
                    counts[letters[:length].encode() + b"*"] += n
    return counts


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, other documents) per batch."""
    for batch in batches:
        toxic: Counter = Counter()
        other: Counter = Counter()
        for label, text in zip(_list(batch, "toxic"), texts_of(batch, "text")):
            (toxic if label else other).update(term_counts(text).keys())
        terms = list(toxic.keys() | other.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.binary()),
                pa.array([toxic[t] for t in terms], pa.int64()),
                pa.array([other[t] for t in terms], pa.int64()),
            ],
            names=["term", "in_toxic", "in_other"],
        )


def _list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _beginnings(word: bytes) -> list[bytes]:
    """The terms that a word gives, itself first: the ones that ``term_counts`` names."""
    if len(word) < 5:
        return [word]
    if word.isascii():
        return [word, word[:4] + b"*", word[:5] + b"*"] if len(word) > 5 else [word, word[:4] + b"*"]
    letters = word.decode("utf-8", "replace")
    return [word, *[letters[:n].encode() + b"*" for n in (4, 5) if len(letters) > n]]


def _keys(word: bytes) -> list[int]:
    return list(map(xxh3_64_intdigest, _beginnings(word)))


class _Met:
    """The words that a task has met, numbered, and the numbered terms that they give.

    A word is cut and hashed when it is first met, so texts that share words share that work.
    """

    def __init__(self, speaks: Callable[[bytes], bool] | None = None):
        self.speaks = speaks
        self.words: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers: defaultdict[int, int] = defaultdict(count().__next__)  # of terms, by hash
        self.given = np.empty((0, 3), np.int32)  # the terms of each word, -1 for none
        self.spoken = np.empty(0, bool)
        self.hashes = np.empty(0, np.uint64)

    def full(self) -> bool:
        return len(self.words) > 300_000

    def learn(self) -> None:
        """Completes what is known of the words numbered last."""
        new = list(islice(self.words, len(self.given), None))
        terms = list(map(_beginnings, new))
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        hashes = map(xxh3_64_intdigest, chain.from_iterable(terms))
        numbers = np.fromiter(map(self.numbers.__getitem__, hashes), np.int32, int(sizes.sum()))
        given = np.full((len(new), 3), -1, np.int32)
        given[np.arange(3) < sizes[:, None]] = numbers
        self.given = np.concatenate([self.given, given])
        hashes = islice(self.numbers, len(self.hashes), None)
        self.hashes = np.concatenate([self.hashes, np.fromiter(hashes, np.uint64)])
        if self.speaks:
            self.spoken = np.concatenate([self.spoken, np.fromiter(map(self.speaks, new), bool, len(new))])


def _hashed(
    texts: Iterable[bytes], speaks: Callable[[bytes], bool] | None = None, known: _Met | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place among the terms, count) of every term of every text, and the hashes of the terms.

    Terms met before, in ``known``, keep their places. With ``speaks`` (that of ``known``, if given) only
    texts that have a word that does are given.
    """
    known = known or _Met(speaks)
    sizes, codes = [], [np.empty(0, np.int64)]
    for text in texts:
        words = text.translate(_WORDS).split()
        sizes.append(len(words))
        codes.append(np.fromiter(map(known.words.__getitem__, words), np.int64, len(words)))
    known.learn()
    width = max(1, len(known.words))
    pair, often = np.unique(
        np.repeat(np.arange(len(sizes)), sizes) * width + np.concatenate(codes), return_counts=True
    )
    owner, word = np.divmod(pair, width)
    if known.speaks:
        heard = np.zeros(len(sizes), bool)
        heard[owner[known.spoken[word]]] = True
        owner, word, often = (x[heard[owner]] for x in (owner, word, often))
    # each word's terms, added up where words of a text share one
    width = max(1, len(known.hashes))
    parts = []
    for nth in range(3):
        term = known.given[word, nth]
        has = term >= 0
        parts.append((owner[has] * width + term[has], often[has]))
    pair, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([n for _, n in parts]), len(pair)).astype(np.int64)
    owner, term = np.divmod(pair, width)
    return owner, term, total, known.hashes.view(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose terms take little memory."""
    for start in range(0, batch.num_rows, 512):
        yield batch.slice(start, 512)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term hash, documents), repeated where a task meets many words."""

    def given(terms: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(rows)], names=["term", "n"])

    known, terms, rows = _Met(), np.empty(0, np.int64), np.empty(0, np.int64)
    for part in chain.from_iterable(map(_slices, batches)):
        _, term, _, terms = _hashed(texts_of(part, "text"), known=known)
        before, rows = rows, np.bincount(term, minlength=len(terms))
        rows[: len(before)] += before
        if known.full():
            yield given(terms, rows)
            known, terms, rows = _Met(), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(terms):
        yield given(terms, rows)


def _among(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` stand in the sorted ``known``, and the places of those."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    met = known[at] == wanted
    return met, at[met]


def _lists(owner: np.ndarray, values: np.ndarray, size: int, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=size))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _vectors(terms: list[bytes], common: np.ndarray, idf: np.ndarray):
    """Adds the places and counts of the telling terms and what the whole text's length is made of.

    ``common_part`` is the square of the length from the ``common`` terms (sorted hashes); the
    other terms are given as ``rare`` with their counts. A text without any telling term needs
    no length.
    """
    hashes = np.array([xxh3_64_intdigest(term) for term in terms], np.uint64).view(np.int64)
    order = np.argsort(hashes)
    telling = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(telling.view(np.uint64).tolist())
        known = None
        for batch in chain.from_iterable(map(_slices, batches)):
            if known is None or known.full():
                known = _Met(lambda word: not wanted.isdisjoint(_keys(word)))
                place_of, idf_of = np.empty(0, np.int64), np.empty(0)
            size = batch.num_rows
            owner, term, often, terms = _hashed(texts_of(batch, "text"), known=known)
            # a term is looked up when it is first met, its documents by number
            new = terms[len(place_of) :]
            new_place, new_idf = np.full(len(new), -1), np.full(len(new), np.nan)
            told, at = _among(telling, new)
            new_place[told] = order[at]
            met, at = _among(common, new)
            new_idf[met] = idf[at]
            place_of, idf_of = np.concatenate([place_of, new_place]), np.concatenate([idf_of, new_idf])
            place = place_of[term]
            told = place >= 0
            owner_of, place = owner[told], place[told]
            by_place = np.lexsort((place, owner_of))
            place_count = often[told][by_place]
            met = ~np.isnan(idf_of[term])
            part = ((1 + np.log(often[met])) * idf_of[term[met]]) ** 2
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    _lists(owner_of, place[by_place], size, pa.int32()),
                    _lists(owner_of, place_count, size, pa.int32()),
                    pa.array(np.bincount(owner[met], part, size).astype(float)),
                    _lists(owner[~met], terms[term[~met]], size, pa.int64()),
                    _lists(owner[~met], often[~met], size, pa.int32()),
                ],
                names=[*names, "places", "counts", "common_part", "rare", "rare_counts"],
            )

    return run


_VECTOR = "places array<int>, counts array<int>, common_part double, rare array<long>, rare_counts array<int>"


def _with_length(vectors: DataFrame, frequency: DataFrame, rows: int) -> DataFrame:
    """Replaces the parts by ``length``, that of all terms of the text."""
    one = F.explode(F.arrays_zip("rare", "rare_counts"))
    rare = vectors.select("row_id", one.alias("one")).select(
        "row_id", F.col("one.rare").alias("term"), F.col("one.rare_counts").alias("count")
    )
    weight = (1 + F.log("count")) * (F.log(F.lit(1.0 + rows) / (1 + F.col("n"))) + 1)
    parts = rare.join(frequency, "term").groupBy("row_id").agg(F.sum(weight * weight).alias("rare_part"))
    length = F.sqrt(F.col("common_part") + F.coalesce("rare_part", F.lit(0.0)))
    met = vectors.join(parts, "row_id", "left").withColumn("length", length)
    return met.drop("common_part", "rare", "rare_counts", "rare_part")


def weighed(places: list[int], counts: list[int], idf: np.ndarray, length: float | None = None) -> np.ndarray:
    """TF-IDF of a document's terms by the length of its whole text, which is theirs if not given."""
    if not places:
        return np.empty(0)
    value = (1 + np.log(np.array(counts, float))) * idf[np.array(places)]
    size = np.linalg.norm(value) if length is None else length
    return value / size if size else value


@dataclass
class BlockMaxIndex:
    """Postings of every term by example, block bounds, and exact top-k search."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[tuple[list[int], np.ndarray]]
    width: int
    block: int
    bounds: np.ndarray = field(init=False)

    def __post_init__(self):
        blocks = max(1, -(-len(self.vectors) // self.block))
        sizes = [len(places) for places, _ in self.vectors]
        example = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))
        place = np.fromiter(chain.from_iterable(places for places, _ in self.vectors), np.int64, len(example))
        value = np.concatenate([np.empty(0), *[values for _, values in self.vectors]])
        order = np.lexsort((example, place))
        self.example, self.value = example[order], value[order]
        # the postings of a term in a block stand together, from this start on
        cell = place[order] * blocks + self.example // self.block
        self.starts = np.searchsorted(cell, np.arange(self.width * blocks + 1))
        self.bounds = np.zeros(self.width * blocks)
        np.maximum.at(self.bounds, cell, self.value)
        self.bounds = self.bounds.reshape(self.width, blocks)

    def _totals(self, places: np.ndarray, values: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Similarities of all examples in the blocks; those of the others are 0."""
        cells = places[:, None] * self.bounds.shape[1] + blocks
        start = self.starts[cells]
        held = self.starts[cells + 1] - start
        value = np.repeat(values, held.sum(axis=1))
        start, held = start.ravel(), held.ravel()
        at = np.repeat(start - np.cumsum(held) + held, held) + np.arange(len(value))
        return np.bincount(self.example[at], value * self.value[at], len(self.vectors))

    def search(self, places: list[int], values: np.ndarray, k: int, without: int | np.ndarray = -1):
        """The k most similar examples with a common term, but for some: (numbers, similarities)."""
        skipped = np.atleast_1d(without)
        skipped = skipped[skipped >= 0]
        numbers, sims, worst = np.empty(0, np.int64), np.empty(0), 0.0
        if not len(places):
            return numbers, sims
        places = np.asarray(places, np.int64)
        reach = values @ self.bounds[places]
        order = np.argsort(-reach, kind="stable")
        order, done, more = order[reach[order] > 0], 0, 1
        while done < len(order):
            # a block that can only tie may still win by its smaller id
            near = order[done : done + more]
            if len(sims) == k:
                near = near[reach[near] >= worst - 1e-9]
            if not len(near):
                break
            done, more = done + more, 2 * more
            total = self._totals(places, values, np.sort(near))
            total[skipped] = 0.0
            hit = np.flatnonzero(total > 0)
            # sums are rounded so that equal examples tie whatever their block
            numbers = np.concatenate([numbers, hit])
            sims = np.concatenate([sims, np.round(total[hit], 9)])
            best = np.lexsort((self.ids[numbers], -sims))[:k]
            numbers, sims = numbers[best], sims[best]
            worst = sims[-1] if len(sims) else 0.0
        return numbers, sims


@dataclass
class ToxicModel:
    terms: list[bytes]
    idf: np.ndarray
    index: BlockMaxIndex
    base: float  # share of toxic rows among all labelled ones
    weights: np.ndarray  # of class 0 and 1: rows of the class per example
    steps: list[tuple[float, float]]  # raw vote from which on a calibrated score holds
    silent: float  # score of a document without any of the terms
    neighbours: int  # how many vote
    same: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # examples of each text

    def vote(self, numbers: np.ndarray, sims: np.ndarray, params: ToxicParams) -> float:
        label = self.index.labels[numbers]
        force = sims * self.weights[label]
        return float((force[label == 1].sum() + params.prior_votes * self.base) / (force.sum() + params.prior_votes))

    def score(self, raw: float) -> float:
        at = np.searchsorted([edge for edge, _ in self.steps], raw, side="right") - 1
        return self.steps[max(0, at)][1] if self.steps else self.base


def calibrated(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[tuple[float, float]]:
    """Rising steps of the weighted share of label 1 (pool adjacent violators)."""
    pools: list[list[float]] = []  # edge, weight, weighted label
    for at in np.lexsort((label, raw)):
        if pools and pools[-1][0] == raw[at]:
            pools[-1][1] += weight[at]
            pools[-1][2] += weight[at] * label[at]
        else:
            pools.append([float(raw[at]), float(weight[at]), float(weight[at] * label[at])])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, w, y = pools.pop()
            pools[-1][1] += w
            pools[-1][2] += y
    return [(edge, y / w) for edge, w, y in pools]


def _log_loss(
    steps: list[tuple[float, float]], raw: np.ndarray, label: np.ndarray, weight: np.ndarray
) -> tuple[float, float]:
    """Weighted mean log loss of the calibrated votes, no score surer than one in a thousand, and its error."""
    edges, scores = np.array(steps).T
    score = np.clip(scores[np.searchsorted(edges, raw, side="right") - 1], 0.001, 0.999)
    loss = -np.log(np.where(label == 1, score, 1 - score))
    mean = np.average(loss, weights=weight)
    return float(mean), float(np.linalg.norm(weight * (loss - mean)) / weight.sum())


def held_out(doc_id: Column) -> Column:
    """Rows that must not teach: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    usable: Column | None = None,
    params: ToxicParams | None = None,
) -> tuple[ToxicModel, DataFrame] | tuple[None, None]:
    """The model, and the term vectors of all documents (row_id, doc_id, places, counts, length).

    ``usable`` says which rows of ``labels`` may teach. Of several labels of one document the highest
    counts, null ones are left out. Without any usable label there is no model.
    """
    params = params or ToxicParams()
    told = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    if usable is not None:
        told = told.where(usable)
    told = told.groupBy(F.col(doc_id).cast("long").alias("told_id")).agg(
        (F.max(toxic) > 0).cast("int").alias("toxic")
    )
    counted = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if not counted:
        return None, None
    order = F.xxhash64("told_id", F.lit("toxic"))
    classes = [
        told.where(F.col("toxic") == c).orderBy(order, "told_id").limit(params.examples) for c in (0, 1)
    ]
    chosen = classes[0].unionByName(classes[1])
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(doc_id).cast("long").alias("doc_id"),
        *text_key(F.col(text)),
        F.col(text).alias("text"),
    )
    # one row of each chosen id, however often it is repeated: at most twice ``examples`` rows
    met = read.join(F.broadcast(chosen), read["doc_id"] == chosen["told_id"])
    sample = stored(met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    terms = _chosen_terms(sample, sizes, params)
    counted_terms = read.select("text").mapInArrow(_frequencies, "term long, n long")
    frequency = stored(counted_terms.groupBy("term").agg(F.sum("n").alias("n")), "toxic-frequency")
    rows = read.count()
    # as many rows as terms counted bound the terms that reach the level: at most ``common_terms``
    level = (frequency.agg(F.sum("n")).first()[0] or 0) / params.common_terms
    table = frequency.where(F.col("n") >= level).orderBy("term").toArrow()
    common, in_docs = (table.column(name).to_numpy() for name in ("term", "n"))
    hashes = [int(np.uint64(xxh3_64_intdigest(term)).view(np.int64)) for term in terms]
    asked = docs.sparkSession.createDataFrame([(h,) for h in hashes], "term long")
    seen = {r["term"]: r["n"] for r in frequency.join(asked, "term").collect()}
    idf = np.log((1 + rows) / (1 + np.array([seen.get(h, 0) for h in hashes], float))) + 1
    make = _vectors(terms, common, np.log((1 + rows) / (1 + in_docs)) + 1)
    keyed = "row_id long, doc_id long, text_a long, text_b long"
    found = stored(read.mapInArrow(make, f"{keyed}, {_VECTOR}"), "toxic-vectors")
    vectors = _with_length(found, frequency, rows)

    number = F.monotonically_increasing_id().alias("row_id")
    numbered = sample.select(number, "doc_id", *text_key(F.col("text")), "toxic", "text")
    taught = stored(numbered.mapInArrow(make, f"{keyed}, toxic int, {_VECTOR}"), "toxic-examples")
    marked = _with_length(taught, frequency, rows)
    marked = marked.select("doc_id", "toxic", "text_a", "text_b", "places", "counts", "length")
    # the bounded sample, as sparse vectors
    examples = sorted(tuple(r) for r in marked.collect())
    return _model(examples, terms, idf, counted, params), vectors


def _chosen_terms(sample: DataFrame, sizes: dict[int, int], params: ToxicParams) -> list[bytes]:
    """All terms of the sample whose log-likelihood ratio tells toxic from other examples."""
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    counts = sample.select("toxic", "text").mapInArrow(
        _term_rows, "term binary, in_toxic long, in_other long"
    )
    a, b = F.col("a"), F.col("b")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / F.lit(float(n1 + n0))
    gain = 2 * (
        part(a, share * n1)
        + part(b, share * n0)
        + part(F.lit(n1) - a, (1 - share) * n1)
        + part(F.lit(n0) - b, (1 - share) * n0)
    )
    summed = counts.groupBy("term").agg(F.sum("in_toxic").alias("a"), F.sum("in_other").alias("b"))
    # only terms that speak for the label: neighbours without any are no evidence
    telling = summed.where((a + b >= params.least_rows) & (a * n0 > 2 * b * n1)).withColumn("gain", gain)
    best = telling.where(F.col("gain") >= params.least_gain).orderBy(F.desc("gain"), "term")
    return [bytes(r["term"]) for r in best.select("term").collect()]


def _model(examples, terms, idf, counted, params) -> ToxicModel:
    total = sum(counted.values())
    base = counted.get(1, 0) / total
    labels = np.array([e[1] for e in examples], np.int64)
    vectors = [(list(e[4]), weighed(e[4], e[5], idf, e[6])) for e in examples]
    by_text: dict[tuple[int, int], list[int]] = {}
    for at, e in enumerate(examples):
        by_text.setdefault(e[2:4], []).append(at)
    same = {key: np.array(numbers) for key, numbers in by_text.items()}
    index = BlockMaxIndex(np.array([e[0] for e in examples], np.int64), labels, vectors, len(terms), params.block)
    # classes are sampled apart; a weight restores their shares
    held = np.maximum(1, np.bincount(labels, minlength=2))
    weights = np.array([counted.get(0, 0), counted.get(1, 0)]) / held
    weights = weights / max(weights.max(), 1e-12)
    model = ToxicModel(terms, idf, index, base, weights, [], base, min(params.neighbours), same)
    spoken = [at for at, (places, _) in enumerate(vectors) if places]
    most = max(params.neighbours)
    near = [index.search(*vectors[at], most, same[examples[at][2:4]]) for at in spoken]
    own = weights[labels]
    tried = []
    for k in sorted(params.neighbours) if spoken else ():
        raw = np.array([model.vote(numbers[:k], sims[:k], params) for numbers, sims in near])
        steps = calibrated(raw, labels[spoken], own[spoken])
        tried.append((*_log_loss(steps, raw, labels[spoken], own[spoken]), steps, k))
    if tried:
        # the fewest neighbours that are no worse than the best, within its error
        least, error, *_ = min(tried, key=lambda one: one[0])
        _, _, model.steps, model.neighbours = next(one for one in tried if one[0] <= least + error)
    silent = np.array([not places for places, _ in vectors], bool)
    if silent.any():
        model.silent = float((own[silent] * labels[silent]).sum() / own[silent].sum())
    return model


def _judge(model: ToxicModel, params: ToxicParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, near, alike = [], [], [np.empty(0, np.int64)], [np.empty(0)]
            names = ("text_a", "text_b", "places", "counts", "length")
            for text_a, text_b, places, counts, length in zip(*[_list(batch, name) for name in names]):
                if not places:
                    found.append(model.silent)
                    sizes.append(0)
                    continue
                values = weighed(places, counts, model.idf, length)
                numbers, sims = model.index.search(
                    places, values, model.neighbours, model.same.get((text_a, text_b), -1)
                )
                found.append(model.score(model.vote(numbers, sims, params)))
                sizes.append(len(sims))
                near.append(model.index.ids[numbers])
                alike.append(sims)
            owner = np.repeat(np.arange(batch.num_rows), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    pa.array(found, pa.float64()),
                    _lists(owner, np.concatenate(near), batch.num_rows, pa.int64()),
                    _lists(owner, np.concatenate(alike), batch.num_rows, pa.float64()),
                ],
                names=["doc_id", "score", "neighbours", "similarities"],
            )

    return run


def judge(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    usable: Column | None = None,
    params: ToxicParams | None = None,
) -> DataFrame:
    """One row per input row: doc_id, score, neighbours, similarities, predicted.

    A text is searched without the examples that are that very text, so no label is evidence for its
    own row, and equal texts score equally whatever their ids. Of several texts under one labelled id
    the first by bytes teaches. Every term that tells the classes apart by ``least_rows`` and ``least_gain`` is
    compared. Null and empty texts, and texts without any telling term, have no neighbours and get the share of
    toxic examples among such texts. Without usable labels every score is 0. Rows repeated with one id are
    scored each; an empty table gives an empty result.
    """
    params = params or ToxicParams()
    model, vectors = train(docs, labels, doc_id, text, toxic, usable, params)
    schema = "doc_id long, score double, neighbours array<long>, similarities array<double>"
    if model is None:
        judged = docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.lit(0.0).alias("score"),
            F.array().cast("array<long>").alias("neighbours"),
            F.array().cast("array<double>").alias("similarities"),
        )
    else:
        judged = vectors.drop("row_id").mapInArrow(_judge(model, params), schema)
    return judged.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
