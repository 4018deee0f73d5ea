"""Language identification by Bayesian fusion of evidence.

The text gives a likelihood (letter trigrams, trained on a bounded sample of labelled rows of each language), a
language declared in markup or metadata another, and the host a prior: the languages of
its other documents, smoothed towards those of its address suffix, which are smoothed towards
those of all documents. Priors and the reliability of declarations are grouped sums of text
posteriors over all documents. A class ``und`` with even odds for every trigram takes what is no
trained language; it is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_rows, sampled, stored, text_key
from ledgerspark.llm.shingles import texts_of

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    sample: int = 5_000  # labelled rows of each language that train the trigrams, at most
    least_rows: int = 3  # rows that make a language known
    languages: int = 64  # known languages, at most: those with the most rows
    buckets: int = 1 << 16
    unseen: float = 0.02  # share of a language's probability spread evenly over all trigrams
    trigram_weight: float = 0.25  # neighbouring trigrams repeat each other
    suffix_strength: float = 50.0  # documents that the prior above counts for
    host_strength: float = 20.0
    declared_smoothing: float = 1.0
    least_probability: float = 0.5


#: A-Z lowered, every other ASCII character but a-z a blank; bytes of other scripts stay.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def trigrams(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of the letter trigrams; words are parted by one blank."""
    letters = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8)
    blank = letters == 32
    letters = letters[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    if len(letters) < 3:
        return np.empty(0, np.int64)
    code = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(8)).astype(np.int64) % buckets


def _counter(params: LanguageParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            sums: dict[str, np.ndarray] = {}
            rows: dict[str, int] = {}
            for label, text in zip(labels, texts_of(batch, "text")):
                counted = np.bincount(trigrams(text, params.buckets), minlength=params.buckets)
                sums[label] = sums.get(label, 0) + counted
                rows[label] = rows.get(label, 0) + 1
            for label, counted in sums.items():
                at = np.flatnonzero(counted)
                bucket = np.concatenate(([-1], at))  # -1 counts rows
                count = np.concatenate(([rows[label]], counted[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(bucket)), pa.array(bucket), pa.array(count, pa.int64())],
                    names=["label", "bucket", "n"],
                )

    return run


@dataclass(frozen=True)
class TrigramModel:
    languages: tuple[str, ...]
    log_odds: np.ndarray  # language x bucket: log P(bucket | language)


def train(
    docs: DataFrame, doc_id: str, text: str, label: str, params: LanguageParams | None = None
) -> TrigramModel:
    """Trigram counts of at most ``sample`` labelled rows of each language, the same ones whenever it runs.

    A language is a primary subtag of two or three letters. Counts over all rows settle which are known,
    so a rare one is known in a table of any size; of more than ``languages``, as junk tags make them,
    those with the most rows are, ties by name. So the model's size does not depend on the tags.
    """
    params = params or LanguageParams()
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), primary(F.col(label)).alias("label")
    ).where(F.col("label").rlike("^[a-z]{2,3}$"))
    sizes = named.groupBy("label").count().where(F.col("count") >= params.least_rows)
    sizes = sizes.orderBy(F.desc("count"), "label").limit(params.languages).collect()
    counts = {r["label"]: r["count"] for r in sizes}
    known = sorted(counts)
    chosen = sampled(named.select("label", "doc_id"), "label", "doc_id", "language", counts, params.sample)
    chosen = chosen.select(F.col("doc_id").alias("chosen"), F.col("label").alias("of")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("label") == F.col("of"))
    # at most ``sample`` ids a language
    rows = named.join(F.broadcast(chosen), same, "left_semi")
    counts = rows.select("label", "text").mapInArrow(_counter(params), "label string, bucket long, n long")
    # at most ``languages`` times ``buckets`` rows
    found = counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).where("bucket >= 0").toArrow()
    table = np.zeros((len(known), params.buckets))
    at = np.searchsorted(known, found["label"].to_numpy()) if known else np.empty(0, int)
    table[at, found["bucket"].to_numpy()] = found["n"].to_numpy()
    seen = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    mixed = (1 - params.unseen) * seen + params.unseen / params.buckets
    return TrigramModel(tuple(known), np.log(mixed).astype(np.float32))


def _scorer(model: TrigramModel, params: LanguageParams):
    even = -math.log(params.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.ascontiguousarray(model.log_odds.T)
        for batch in batches:
            sizes, sums = [], []
            for text in texts_of(batch, "text"):
                found = trigrams(text, params.buckets)
                sizes.append(len(found))
                own = by_bucket[found].sum(axis=0, dtype=float).tolist()
                sums.append([params.trigram_weight * s for s in [*own, len(found) * even]])
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
                names=[*names, "n_trigrams", "text_log"],
            )

    return run


def primary(tag: Column) -> Column:
    """Primary part of a language tag in lower case: ``en`` of ``en-GB``; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]+)", 1))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds text, declared, host and suffix, read from a page's markup and address."""
    markup = F.coalesce(F.col(html), F.lit(""))
    bare = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\w+://([^/:?#]+)", 1))
    declared = F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return pages.withColumns(
        {"text": bare, "declared": declared, "host": host, "suffix": F.substring_index(host, ".", -1)}
    )


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _sums(rows: DataFrame, key: str, width: int) -> DataFrame:
    """One row per key: the posteriors of its rows added up."""
    columns = [F.sum(F.col("text_p")[i]).alias(f"s{i}") for i in range(width)]
    added = rows.groupBy(key).agg(*columns)
    return added.select(
        F.col(key).alias(f"of_{key}"), F.array(*[f"s{i}" for i in range(width)]).alias(f"{key}_sum")
    )


def identify(
    docs: DataFrame,
    model: TrigramModel,
    doc_id: str = "doc_id",
    text: str = "text",
    declared: str | None = None,
    host: str | None = None,
    suffix: str | None = None,
    params: LanguageParams | None = None,
) -> DataFrame:
    """One row per input row: doc_id, language, probability, text_language, kept, text_a, text_b.

    Evidence whose column is not named, null or blank is left out. A document is ``kept`` if it has
    letters, its language is a trained one and has at least ``least_probability``; null, empty and
    letterless texts are ``und`` and go. Ties go to the language first by name. Rows repeated
    with one id are judged each; an empty table gives an empty result.
    """
    params = params or LanguageParams()
    names = [*model.languages, UNKNOWN]
    width = len(names)

    def evidence(name: str | None) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) if name else F.lit("")

    read = docs.select(
        *text_key(F.col(text)),
        F.col(doc_id).cast("long").alias("doc_id"),
        evidence(host).alias("host"),
        evidence(suffix).alias("suffix"),
        (primary(F.col(declared)) if declared else F.lit("")).alias("declared"),
        F.col(text).alias("text"),
    )
    schema = (
        "text_a long, text_b long, doc_id long, host string, suffix string, declared string, n_trigrams long, "
        "text_log array<double>"
    )
    scored = read.mapInArrow(_scorer(model, params), schema)
    scored = stored(scored.withColumn("text_p", _softmax(F.col("text_log"))), "language-texts")

    sums = scored.agg(*[F.sum(F.col("text_p")[i]) for i in range(width)]).first()
    total = sum(s or 0.0 for s in sums) + width
    overall = F.array(*[F.lit(((s or 0.0) + 1.0) / total) for s in sums])

    def shrunk(own: Column, towards: Column, strength: float) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, towards, lambda s, p: (F.greatest(s, F.lit(0.0)) + strength * p) / (size + strength))

    met = scored
    for key, name in (("suffix", suffix), ("host", host), ("declared", declared)):
        if name is None:
            # a join on a blank that all rows share would gather them in one task
            met = met.withColumn(f"{key}_sum", F.lit(None).cast("array<double>"))
        else:
            added = _sums(scored.where(F.col(key) != ""), key, width)
            met = met.join(added, F.col(key) == F.col(f"of_{key}"), "left")
    # a document's own posterior is no evidence about it
    others = F.zip_with("host_sum", "text_p", lambda s, p: s - p)
    prior = F.when(F.col("suffix_sum").isNull(), overall).otherwise(
        shrunk(F.col("suffix_sum"), overall, params.suffix_strength)
    )
    met = met.withColumn("suffix_prior", prior)
    prior = F.when(F.col("host_sum").isNull(), F.col("suffix_prior")).otherwise(
        shrunk(others, F.col("suffix_prior"), params.host_strength)
    )
    met = met.withColumn("prior", prior)
    # P(declared | language): how often documents of that language declare this one
    declaring = [max(s or 0.0, 0.0) for s in sums]
    smooth = params.declared_smoothing
    per_language = F.array(*[F.lit(d + smooth * width) for d in declaring])
    reliable = F.when(
        F.col("declared_sum").isNotNull(),
        F.zip_with(
            F.zip_with("declared_sum", "text_p", lambda s, p: F.greatest(s - p, F.lit(0.0))),
            per_language,
            lambda s, n: F.log((s + smooth) / n),
        ),
    ).otherwise(F.array(*[F.lit(0.0)] * width))
    fused = F.zip_with(
        F.zip_with("text_log", "prior", lambda t, p: t + F.log(p)), reliable, lambda t, d: t + d
    )
    labels = F.array(*map(F.lit, names))

    def best(values: Column) -> Column:
        return F.element_at(labels, F.array_position(values, F.array_max(values)).cast("int"))

    judged = met.withColumn("posterior", _softmax(fused))
    blank = F.col("n_trigrams") == 0
    language = F.when(blank, UNKNOWN).otherwise(best(F.col("posterior")))
    judged = judged.select(
        "doc_id",
        language.alias("language"),
        F.array_max("posterior").alias("probability"),
        F.when(blank, UNKNOWN).otherwise(best(F.col("text_p"))).alias("text_language"),
        "text_a",
        "text_b",
    )
    kept = (F.col("language") != UNKNOWN) & (F.col("probability") >= params.least_probability)
    return judged.withColumn("kept", kept)


def keep_identified(
    docs: DataFrame, model: TrigramModel, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns."""
    return kept_rows(docs, identify(docs, model, doc_id, text, **options), doc_id, text)
