"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features and ordered thresholds between the grades:
P(grade <= g) = logistic(threshold_g - weights . features). The fit uses a bounded sample of
rated rows; every document is scored in one pass. The expected grade and the tail probability of
each grade select documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ledgerspark.llm.common import sampled
from ledgerspark.llm.shingles import texts_of


@dataclass(frozen=True)
class QualityParams:
    sample: int = 4_000  # rated rows that the fit sees, at most; each grade has an equal part
    word_bits: int = 15
    shape_bits: int = 12
    steps: int = 150
    rate: float = 0.1
    ridge: float = 2e-4
    least_tail: float = 0.5  # tail probability that selects

    @property
    def width(self) -> int:
        return (1 << self.word_bits) + (1 << self.shape_bits)


#: Letters become a or A, digits 9, other scripts' bytes a; the rest stays.
_SHAPES = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b
    for b in range(256)
)


def features(text: bytes, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values: hashed words, word shapes, repeats."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    at, counts = np.unique(hashes & np.uint64((1 << params.word_bits) - 1), return_counts=True)
    value = np.sqrt(counts.astype(np.float32))
    value /= np.linalg.norm(value)
    # runs of one class are one sign: "Word###" has the shape "Aa#"
    signs = np.frombuffer(text.translate(_SHAPES), np.uint8)
    first = np.concatenate(([True], signs[1:] != signs[:-1]))
    shapes = signs[first].tobytes().split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    short = sum(len(line) < 20 for line in lines) / max(1, len(lines))
    stutter = float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0
    shapes += [b"\x00stutter %d" % min(4, round(20 * stutter))] * max(1, len(shapes) // 4)
    shapes += [b"\x00repeated %d" % round(4 * repeated)] * max(1, len(shapes) // 4)
    shapes += [b"\x00short %d" % round(4 * short)] * max(1, len(shapes) // 8)
    marks = np.fromiter(map(xxh3_64_intdigest, shapes), np.uint64, len(shapes))
    mark_at, mark_counts = np.unique(marks & np.uint64((1 << params.shape_bits) - 1), return_counts=True)
    mark_value = np.sqrt(mark_counts.astype(np.float32))
    mark_value *= 2 / np.linalg.norm(mark_value)
    place = np.concatenate([at.astype(np.int64), mark_at.astype(np.int64) + (1 << params.word_bits)])
    return place, np.concatenate([value, mark_value])


def _feature_rows(params: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(text, params) for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("grade")),
                    pa.array([m[0].astype(np.int32).tobytes() for m in made], pa.binary()),
                    pa.array([m[1].tobytes() for m in made], pa.binary()),
                ],
                names=["grade", "places", "figures"],
            )

    return run


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one fewer than grades


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_ordinal(
    rows: list[tuple[int, np.ndarray, np.ndarray]], params: QualityParams, counts: dict[int, int] | None = None
) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows; the same rows give the same model.

    ``counts`` has the documents of each grade that the rows stand for; weights restore their shares.
    """
    grades = tuple(sorted({g for g, _, _ in rows}))
    weights = np.zeros(params.width)
    if len(grades) < 2:
        return OrdinalModel(grades, weights, np.zeros(0))
    level = np.array([grades.index(g) for g, _, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(p) for _, p, _ in rows])
    place = np.concatenate([p for _, p, _ in rows])
    value = np.concatenate([v for _, _, v in rows]).astype(float)
    held = np.bincount(level)
    stands = np.array([counts[g] for g in grades]) / held if counts else np.ones(len(grades))
    own = stands[level] / (stands @ held)
    shares = np.cumsum(stands * held / (stands @ held))[:-1]
    start = np.log(shares / (1 - shares))
    # thresholds are a first one and positive steps, so their order cannot break
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    both = np.concatenate([weights, free])
    mean, spread = np.zeros_like(both), np.zeros_like(both)
    last = len(grades) - 1
    for step in range(1, params.steps + 1):
        weights, free = both[: params.width], both[params.width :]
        steps = np.exp(free[1:])
        thresholds = np.concatenate([free[:1], free[0] + np.cumsum(steps)])
        line = np.bincount(owner, value * weights[place], len(rows))
        upper = np.where(level < last, _logistic(thresholds[np.minimum(level, last - 1)] - line), 1.0)
        lower = np.where(level > 0, _logistic(thresholds[np.maximum(level - 1, 0)] - line), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        slope = (up - low) * own  # of the loss by the line
        gradient = np.bincount(place, value * slope[owner], params.width) + params.ridge * weights
        by_threshold = np.zeros(last)
        np.add.at(by_threshold, np.minimum(level, last - 1), np.where(level < last, -up, 0.0) * own)
        np.add.at(by_threshold, np.maximum(level - 1, 0), np.where(level > 0, low, 0.0) * own)
        tails = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([gradient, tails[:1], tails[1:] * steps])
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        both = both - params.rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    weights, free = both[: params.width], both[params.width :]
    thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    return OrdinalModel(grades, weights, thresholds)


def train(
    docs: DataFrame,
    ratings: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    params: QualityParams | None = None,
) -> OrdinalModel:
    """Fits on at most ``sample`` rated documents, the same ones whenever it runs.

    Null grades and ratings without a document are left out; of several ratings of one document the lowest
    counts, of several texts under one id the first by bytes. Every grade that occurs is sampled, however rare it is.
    """
    params = params or QualityParams()
    rated = ratings.where(F.col(grade).isNotNull() & F.col(doc_id).isNotNull())
    rated = rated.groupBy(F.col(doc_id).alias("rated_id")).agg(F.min(grade).cast("int").alias("grade"))
    present = docs.select(F.col(doc_id).alias("rated_id"))
    rated = rated.join(present, "rated_id", "left_semi")
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    part = max(1, params.sample // max(1, len(counts)))
    chosen = sampled(rated, "grade", "rated_id", "quality", counts, part)
    rows = docs.select(F.col(doc_id).alias("rated_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "rated_id"
    )
    # one row of each id, however often it is repeated: at most ``sample`` rows
    rows = rows.groupBy("rated_id", "grade").agg(F.min("text").alias("text"))
    made = rows.select("rated_id", "grade", "text").mapInArrow(
        _feature_rows(params), "grade int, places binary, figures binary"
    )
    sample = sorted((r["grade"], bytes(r["places"]), bytes(r["figures"])) for r in made.collect())
    return fit_ordinal(
        [(g, np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for g, p, v in sample], params, counts
    )


def _scorer(model: OrdinalModel, params: QualityParams):
    weights = model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = np.array(model.grades or (0,), float)
        for batch in batches:
            tails = np.empty((batch.num_rows, max(0, len(grades) - 1)))
            for at, text in enumerate(texts_of(batch, "text")):
                place, value = features(text, params)
                tails[at] = 1 - _logistic(model.thresholds - float(value @ weights[place]))
            expected = grades[0] + tails @ np.diff(grades)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(0, tails.size + 1, max(1, tails.shape[1]))[: batch.num_rows + 1], pa.int32())
                if tails.shape[1]
                else pa.array(np.zeros(batch.num_rows + 1), pa.int32()),
                pa.array(tails.ravel()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(expected), flat],
                names=["doc_id", "expected_grade", "tails"],
            )

    return run


def reaching(model: OrdinalModel, grade: int) -> Column:
    """P(grade >= ``grade``) of scored rows: that of the lowest known grade which is no less."""
    below = sum(g < grade for g in model.grades)
    if below == 0:
        return F.lit(1.0)
    return F.lit(0.0) if below == len(model.grades) else F.element_at("tails", below)


def score(
    docs: DataFrame,
    model: OrdinalModel,
    doc_id: str = "doc_id",
    text: str = "text",
    grade: int | None = None,
    params: QualityParams | None = None,
) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tails, kept.

    ``tails`` holds P(grade >= g) for every grade but the lowest, ``kept`` says whether that of
    ``grade`` (default: the second) reaches ``least_tail``; a grade that nobody gave counts as the next
    higher known one, and above all of them no document is kept. Null and empty texts have no
    features and get the thresholds' own figures. Without two grades to learn from every document has
    the one grade (or 0) and is kept unless that is below ``grade``. Rows repeated with one id are scored each; an empty table
    gives an empty result.
    """
    params = params or QualityParams()
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = read.mapInArrow(
        _scorer(model, params), "doc_id long, expected_grade double, tails array<double>"
    )
    if grade is None:
        grade = model.grades[1] if len(model.grades) > 1 else min(model.grades, default=0)
    return scored.withColumn("kept", reaching(model, grade) >= params.least_tail)
