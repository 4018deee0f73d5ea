"""Near duplicates by MinHash, banding and odd sketches.

1. One pass over the texts gives every document the size and digest of its shingle set, its
   MinHash bands and an odd sketch: the samples, folded into a bitmap by parity. The number
   of bits in which two sketches differ estimates their similarity, precisely where it is high.
2. Documents of one set are one class; only its first row goes on.
3. Classes that share a band are candidates. Their pairs are never listed: a bucket compares
   its members with one pivot, twice; links found join components, and only buckets that
   still hold several components are compared throughout, block against block inside tasks.
4. Pairs that the sketches leave are confirmed on the full sets.

With 40 bands of 5 rows a pair of similarity 0.8 shares no band once in 10^7; the sketch bound,
set for 0.65, refuses such a pair a few times in 10^6. Both fall fast above 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import kept_rows, may_hold, stored, text_key
from ledgerspark.llm.components import components
from ledgerspark.llm.shingles import (
    factors,
    lists_of,
    scrambled,
    set_digest,
    shingle_set,
    texts_of,
)


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    bits: int = 1024
    seed: int = 11
    sketch_similarity: float = 0.65
    pivot_rounds: int = 2
    block: int = 2048

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def max_differing(self) -> int:
        """Differing sketch bits expected at ``sketch_similarity``."""
        spread = 4 * self.samples * (1 - self.sketch_similarity) / self.bits
        return int(np.ceil(self.bits / 2 * (1 - np.exp(-spread))))


SKETCH = (
    "row_id long, doc_id long, text_a long, text_b long, n_shingles long, set_a long, set_b long, "
    "bands array<long>, odd array<long>"
)
PASSED = ["row_id", "doc_id", "text_a", "text_b"]


def minhashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        part = shingles[start : start + 512, None] * multipliers[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Rows of MinHash samples folded into ``bits`` parities each, as 64-bit words."""
    count, width = samples.shape
    places = scrambled(samples + factors(width, 5)[None, :]) % np.uint64(bits)
    flat = places + (np.arange(count, dtype=np.uint64) * np.uint64(bits))[:, None]
    odd = np.bincount(flat.ravel().astype(np.int64), minlength=count * bits) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(count, bits), axis=1, bitorder="little")
    return packed.view(np.int64)


def sketcher(params: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = factors(params.samples, params.seed)
        place_factors = factors(params.shingle, params.seed + 1)
        row_factors = factors(params.rows, params.seed + 2)
        band_salt = factors(params.bands, params.seed + 3)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, digests, samples = [], [], np.empty((part.num_rows, params.samples), np.uint64)
                for at, text in enumerate(texts_of(part, "text")):
                    shingles = shingle_set(text, params.shingle, place_factors)
                    sizes.append(len(shingles))
                    digests.append(set_digest(shingles))
                    samples[at] = minhashes(shingles, multipliers)
                some = np.array(sizes) > 0
                grouped = samples.reshape(-1, params.bands, params.rows) * row_factors
                keys = scrambled(grouped.sum(axis=2, dtype=np.uint64) + band_salt[None, :])
                odd = odd_sketches(samples, params.bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(part.schema.get_field_index(name)) for name in PASSED],
                        pa.array(sizes, pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        lists_of(keys[some].view(np.int64).ravel(), some * params.bands),
                        lists_of(odd[some].ravel(), some * odd.shape[1]),
                    ],
                    names=[name.split()[0] for name in SKETCH.split(", ")],
                )

    return run


def set_maker(params: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_factors = factors(params.shingle, params.seed + 1)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(t, params.shingle, place_factors) for t in texts_of(part, "text")]
                digests = [set_digest(s) for s in sets]
                flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        lists_of(flat.view(np.int64), np.array([len(s) for s in sets])),
                    ],
                    names=["set_a", "set_b", "shingles"],
                )

    return run


def _differing(one: str, other: str) -> Column:
    apart = F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(apart, F.lit(0), lambda total, bits: total + bits)


def _confirmed(pairs: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_one"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_two"))
    common = F.size(F.array_intersect("set_one", "set_two"))
    union = F.size("set_one") + F.size("set_two") - common
    return pairs.join(one, "a").join(other, "b").where(100 * common >= params.percent * union).select("a", "b")


def _plausible(pairs: DataFrame, sketches: DataFrame, params: NearParams) -> DataFrame:
    """The pairs that sizes and odd sketches do not rule out."""
    one = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("odd_a"))
    other = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("odd_b"))
    near_size = 100 * F.least("n_a", "n_b") >= params.percent * F.greatest("n_a", "n_b")
    joined = pairs.join(one, "a").join(other, "b").where(near_size)
    return joined.where(_differing("odd_a", "odd_b") <= params.max_differing).select("a", "b")


def _pivot_pairs(open_rows: DataFrame, turn: int) -> DataFrame:
    """Each member of an open bucket with the bucket's pivot, where their components differ."""
    # the first pivot is the smallest node, so that buckets of one group share it
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    pivots = open_rows.groupBy("key").agg(F.min_by(F.struct("node", "label"), order).alias("pivot"))
    joined = open_rows.join(pivots, "key").where("label != pivot.label")
    pivot = F.col("pivot.node")
    return joined.select(F.least("node", pivot).alias("a"), F.greatest("node", pivot).alias("b")).distinct()


def _still_open(buckets: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows (key, node, label) of the buckets that hold several components."""
    label = F.coalesce(F.col("b"), F.col("node")).alias("label")
    rows = buckets.join(stars, buckets["node"] == stars["a"], "left").select("key", "node", label)
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(several.where("low != high").select("key"), "key")


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a batch; a list of one length per row is a matrix, shingle sets are objects."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if not pa.types.is_list(column.type):
            out[name] = column.to_numpy()
            continue
        flat = column.flatten().to_numpy().view(np.uint64)
        if name == "shingles":
            bounds = column.offsets.to_numpy() - column.offsets[0].as_py()
            sets = np.empty(batch.num_rows, object)
            sets[:] = [flat[i:j] for i, j in zip(bounds, bounds[1:])]
            out[name] = sets
        else:
            out[name] = flat.reshape(batch.num_rows, -1)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each (key, one, two), which arrive one after the other."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        if rest is not None:
            rows = {name: np.concatenate((rest[name], rows[name])) for name in rows}
        changed = np.zeros(len(rows["key"]), bool)
        for name in ("key", "one", "two"):
            changed[1:] |= rows[name][1:] != rows[name][:-1]
        bounds = [0, *np.flatnonzero(changed)]
        for begin, end in zip(bounds, bounds[1:]):
            yield {name: values[begin:end] for name, values in rows.items()}
        rest = {name: values[bounds[-1] :] for name, values in rows.items()}
    if rest is not None:
        yield rest


def _plausible_places(group: dict[str, np.ndarray], params: NearParams):
    """Places (i, j) of pairs across components that sizes and sketches do not rule out.

    A pair counts in the bucket of the first band that it shares, so it is found once.
    """
    same_block = group["one"][0] == group["two"][0]
    left = np.flatnonzero(group["side"] == 0)
    right = left if same_block else np.flatnonzero(group["side"] == 1)
    if not len(right):
        return
    for start in range(0, len(left), 64):
        rows = left[start : start + 64]
        n, m = group["n"][rows][:, None], group["n"][right][None, :]
        close = 100 * np.minimum(n, m) >= params.percent * np.maximum(n, m)
        close &= group["label"][rows][:, None] != group["label"][right][None, :]
        if same_block:
            close &= rows[:, None] < right[None, :]
        i, j = np.nonzero(close)
        i, j = rows[i], right[j]
        apart = np.zeros(len(i), np.int64)
        for word in range(group["odd"].shape[1]):
            apart += np.bitwise_count(group["odd"][i, word] ^ group["odd"][j, word])
        i, j = i[apart <= params.max_differing], j[apart <= params.max_differing]
        first = (group["bands"][i] == group["bands"][j]).argmax(axis=1)
        here = group["bands"][i, first] == group["key"][i].view(np.uint64)
        yield i[here], j[here]


def plausible_finder(params: NearParams):
    """(key, node) of the members of a bucket that a plausible pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            places = [side for pair in _plausible_places(group, params) for side in pair]
            nodes = group["node"][np.unique(np.concatenate(places))] if places else []
            if len(nodes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nodes), group["key"][0])), pa.array(nodes)],
                    names=["key", "node"],
                )

    return run


def link_finder(params: NearParams):
    """Links (a, b) confirmed on the full sets, as many as join the components they join."""

    def common(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        flat = np.concatenate(others)
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        starts = np.cumsum([0, *map(len, others[:-1])])
        return np.add.reduceat((one[at] == flat).astype(np.int64), starts)

    def links(group: dict[str, np.ndarray]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(label: int) -> int:
            while (above := parent.get(label, label)) != label:
                label = above
            return label

        labels = group["label"].tolist()
        for i_all, j_all in _plausible_places(group, params):
            for i in np.unique(i_all):
                own = root(labels[i])
                j = np.array([j for j in j_all[i_all == i] if root(labels[j]) != own], np.int64)
                if not len(j):
                    continue
                both = common(group["shingles"][i], group["shingles"][j])
                union = group["n"][i] + group["n"][j] - both
                for other in j[100 * both >= params.percent * union]:
                    mine, its = root(labels[i]), root(labels[other])
                    if mine != its:
                        parent[its] = mine
                        yield int(group["node"][i]), int(group["node"][other])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            found = list(links(group))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in found]), pa.array([b for _, b in found])], names=["a", "b"]
                )

    return run


def _dealt(rows: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Rows of buckets dealt to pairs of blocks of about ``size`` rows, in order."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    met = rows.join(blocks, "key").withColumn("own", own)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select(
        "key",
        F.least("own", "other").alias("one"),
        F.greatest("own", "other").alias("two"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        *columns,
    )
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "side")


def _block_links(open_rows: DataFrame, sketches: DataFrame, sets: DataFrame, params: NearParams) -> DataFrame:
    """Links across components in the buckets still open: every plausible pair is looked at.

    A bucket of m members makes m / block blocks, a task holds two blocks at a time. The first pass
    finds by sketches which members matter, the second confirms their pairs on the sets. Pairs
    stay inside the tasks.
    """
    columns = ["node", "label", "n", "odd", "bands"]
    rows = open_rows.join(sketches.select("node", "n", "odd", "bands"), "node")
    dealt = _dealt(rows, params.block, columns)
    needed = dealt.mapInArrow(plausible_finder(params), "key long, node long").distinct()
    few = rows.join(stored(needed, "near-needed"), ["key", "node"]).join(sets, "node")
    again = _dealt(few, max(2, params.block // 4), [*columns, "shingles"])
    return again.mapInArrow(link_finder(params), "a long, b long")


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: NearParams | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, stays, text_a, text_b.

    Words are runs without ASCII white space, A-Z lowered. A text of fewer words than a shingle
    has its whole sequence as its one shingle. Null, empty and blank texts have none and are linked with
    nothing; they stay. ``component_id`` is the smallest id reachable over links of
    ``percent`` or more, ``kept`` says whether it is the row's own. Of rows repeated with one
    id, ``stays`` is true for the first only; a null id is never the smallest unless all are
    null. An empty table gives an empty result.
    """
    params = params or NearParams()
    read = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(doc_id).cast("long").alias("doc_id"),
        *text_key(F.col(text)),
        F.col(text).alias("text"),
    )
    sketched = stored(read.mapInArrow(sketcher(params), SKETCH), "near-sketches")

    classes = stored(
        sketched.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(F.min("row_id").alias("node"), F.min("doc_id").alias("first_id")),
        "near-classes",
    )
    first = classes.select(F.col("node").alias("row_id"))
    reps = sketched.join(first, "row_id", "left_semi")
    banded = reps.select(F.col("row_id").alias("node"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.where("low != high").select("key")
    buckets = stored(banded.join(shared, "key"), "near-buckets")
    candidates = buckets.select(F.col("node").alias("row_id")).distinct()
    sketches = stored(
        sketched.join(candidates, "row_id", "left_semi").select(
            F.col("row_id").alias("node"),
            F.col("n_shingles").alias("n"),
            "odd",
            "bands",
            "doc_id",
            "set_a",
            "set_b",
        ),
        "near-candidates",
    )
    # the sets of the candidates, made again from their texts: a set belongs to its class's node
    wanted = sketches.select(F.col("doc_id").alias("wanted")).distinct()
    near = may_hold(wanted, ["wanted"])([F.col("doc_id")])
    texts = read.where(near).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    made = texts.select("text").mapInArrow(set_maker(params), "set_a long, set_b long, shingles array<long>")
    nodes = sketches.select("node", "set_a", "set_b")
    sets = stored(
        made.join(nodes, ["set_a", "set_b"])
        .groupBy("node")
        .agg(F.any_value("shingles").alias("shingles")),
        "near-sets",
    )

    open_rows = buckets.withColumn("label", F.col("node"))
    stars = None
    for turn in range(params.pivot_rounds + 1):
        if turn < params.pivot_rounds:
            pairs = _plausible(_pivot_pairs(open_rows, turn), sketches, params)
            links = _confirmed(pairs, sets, params)
        else:
            links = _block_links(open_rows, sketches, sets, params)
        stars = components(links if stars is None else stars.unionByName(links))
        if turn < params.pivot_rounds:
            open_rows = stored(_still_open(buckets, stars), "near-open")

    label = F.coalesce(F.col("b"), F.col("node")).alias("label")
    labelled = classes.join(stars, classes["node"] == stars["a"], "left").select(
        "set_a", "set_b", "first_id", "node", label
    )
    smallest = labelled.groupBy("label").agg(
        F.min("first_id").alias("component_id"),
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("best"),
    )
    # of the best class, the row that stays is the first one with its smallest id
    members = sketched.select(*PASSED, "n_shingles", "set_a", "set_b")
    own = labelled.join(smallest, "label").select(
        "set_a", "set_b", "label", "component_id", (F.col("node") == F.col("best.node")).alias("best_class")
    )
    joined = members.join(own, ["set_a", "set_b"], "left")
    empty = F.col("n_shingles") == 0
    joined = joined.withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")))
    joined = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = (
        joined.where("kept and best_class and n_shingles > 0")
        .groupBy("label")
        .agg(F.min("row_id").alias("row_id"))
        .select(F.col("row_id").alias("chosen"))
    )
    stays = F.col("chosen").isNotNull() | (F.col("n_shingles") == 0)
    return joined.join(chosen, F.col("row_id") == F.col("chosen"), "left").select(
        "doc_id", "n_shingles", "component_id", "kept", stays.alias("stays"), "text_a", "text_b"
    )


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: NearParams | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    decided = near_groups(docs, doc_id, text, params).drop("kept").withColumnRenamed("stays", "kept")
    return kept_rows(docs, decided, doc_id, text)
