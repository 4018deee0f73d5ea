"""Exact top-k inner products by a pivot-distance index.

Vectors are turned into whole numbers and, by one added component, into points at one distance
from the origin, so that a larger inner product with a query is a smaller distance to it. The
index keys every point by its nearest pivot (the cell) and its distance to it, and is stored
in that order. A query's best scores among the points stored around its own place bound the
distance D of its k-th neighbour; by the triangle inequality a point at distance r from pivot p
can only be nearer than D where ``|r - d(q, p)| <= D``. Queries form groups; each group gets
the annuli of every cell that one of its queries may need, and a task reads its share of an
annulus in the order of that bound, tightens D and stops comparing when the bound passes it.

Everything is exact: pivots (a bounded sample) only affect the amount of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: float = 64.0
    pivots: int = 64
    group_size: int = 4096
    lane_size: int = 16_384
    slack: float = 1e-6  # relative; covers rounding of the distances


VECTOR = "vec_id long, is_query boolean, vec array<double>"
INDEX = f"{VECTOR}, cell int, radius double, floor_score double"


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, query: F.Column, scale: float) -> DataFrame:
    """vec_id, is_query, vec (whole numbers); rows that take no part are left out."""
    scaled = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fine = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~bad
    return vectors.where(fine).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.coalesce(query, F.lit(False)).alias("is_query"),
        scaled.alias("vec"),
    )


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((batch.num_rows, width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def scores(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles hold them below 2^53, objects above."""
    top = np.abs(one).max(initial=0) * np.abs(other).max(initial=0) * max(1, one.shape[1])
    if top < 2**53:
        return one @ other.T
    exact = [[int(v) for v in row] for row in one], [[int(v) for v in row] for row in other]
    return np.array(exact[0], object) @ np.array(exact[1], object).T


class Space:
    """Distances after the added component, to pivots and between queries and points."""

    def __init__(self, pivots: np.ndarray, largest: float):
        # pivots as points of the sphere of radius sqrt(largest)
        self.pivots, self.largest = pivots, largest
        self.lift = np.sqrt(np.maximum(0.0, largest - (pivots**2).sum(axis=1)))

    def of_points(self, points: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0.0, self.largest - (points**2).sum(axis=1)))
        across = points @ self.pivots.T + lift[:, None] * self.lift[None, :]
        return np.sqrt(np.maximum(0.0, 2 * self.largest - 2 * across))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        squares = (queries**2).sum(axis=1)[:, None] + self.largest
        return np.sqrt(np.maximum(0.0, squares - 2 * queries @ self.pivots.T))

    def reach(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a point with this score; endless where there is no score yet."""
        squares = (queries**2).sum(axis=1) + self.largest
        known = np.isfinite(score)
        out = np.full(len(queries), np.inf)
        out[known] = np.sqrt(np.maximum(0.0, squares[known] - 2 * score[known]))
        return out


def _merged(best, ids, found, found_ids, k):
    """The k best of two score tables: higher score first, then smaller id."""
    found, found_ids = np.concatenate([best, found], axis=1), np.concatenate([ids, found_ids], axis=1)
    order = np.lexsort((found_ids, -found), axis=1)[:, :k]
    return np.take_along_axis(found, order, 1), np.take_along_axis(found_ids, order, 1)


def _numbers(product: np.ndarray) -> np.ndarray:
    return product.astype(float) if product.dtype == object else product


def indexer(space: Space, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distances = space.of_points(_matrix(batch, "vec", width))
            cell = distances.argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(distances[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "radius"],
            )

    return run


def home_searcher(params: TopKParams, width: int):
    """Adds each query's k-th best score among the points stored around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_query = _column(batch, "is_query").astype(bool)
            bound = np.full(batch.num_rows, -np.inf)
            at = np.flatnonzero(is_query)
            if len(at) and batch.num_rows > params.k:
                points, ids = _matrix(batch, "vec", width), _column(batch, "vec_id")
                for start in range(0, len(at), 512):
                    some = at[start : start + 512]
                    product = _numbers(scores(points[some], points))
                    product[ids[some][:, None] == ids[None, :]] = -np.inf
                    bound[some] = np.partition(product, -params.k, axis=1)[:, -params.k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bound)], names=[*batch.schema.names, "floor_score"]
            )

    return run


def group_bounds(space: Space, params: TopKParams, width: int):
    """Annulus (low, high) of each cell that a query group may need: one row a batch and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = _column(batch, "query_group")
            queries = _matrix(batch, "vec", width)
            reach = space.reach(queries, _column(batch, "floor_score"))[:, None] * (1 + params.slack)
            distances = space.of_queries(queries)
            out = []
            for group in np.unique(groups):
                own = groups == group
                low = (distances[own] - reach[own]).min(axis=0) - params.slack
                high = (distances[own] + reach[own]).max(axis=0) + params.slack
                out += [(int(group), cell, low[cell], high[cell]) for cell in range(len(low))]
            if out:
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    names=["query_group", "cell", "low", "high"],
                )

    return run


def lane_searcher(space: Space, params: TopKParams, width: int):
    """Searches the lanes of a partition; a lane's queries come first, then its points."""
    found_type = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    class Lane:
        def __init__(self):
            self.ids, self.vecs, self.floors = [], [], []
            self.ready = False

        def add_queries(self, ids, vecs, floors):
            self.ids.append(ids)
            self.vecs.append(vecs)
            self.floors.append(floors)

        def begin(self):
            self.ready = True
            if not self.ids:
                return
            self.id, self.vec = np.concatenate(self.ids), np.concatenate(self.vecs)
            self.floor = np.concatenate(self.floors)
            self.to_pivots = space.of_queries(self.vec)
            self.best = np.full((len(self.id), params.k), -np.inf)
            self.best_ids = np.full((len(self.id), params.k), np.iinfo(np.int64).max)

        def search(self, ids, points, cells, radii):
            if not self.ready:
                self.begin()
            if not self.ids:
                return
            for cell in np.unique(cells):
                own = np.flatnonzero(cells == cell)
                for start in range(0, len(own), 1024):
                    some = own[start : start + 1024]
                    self.annulus(ids[some], points[some], cell, radii[some].min(), radii[some].max())

        def annulus(self, ids, points, cell, low, high):
            reach = space.reach(self.vec, np.maximum(self.floor, self.best[:, -1].astype(float)))
            away = self.to_pivots[:, cell]
            bound = np.maximum(np.maximum(low - away, away - high), 0.0)
            near = np.flatnonzero(bound * (1 - params.slack) <= reach + params.slack)
            for start in range(0, len(near), 512):
                some = near[start : start + 512]
                product = scores(self.vec[some], points)
                if product.dtype == object and self.best.dtype != object:
                    self.best = self.best.astype(object)
                same = self.id[some][:, None] == ids[None, :]
                product[same] = -np.inf
                if product.shape[1] > params.k and product.dtype != object:
                    # keep all that tie with the k-th, so that ids decide between them
                    kth = np.partition(product, -params.k, axis=1)[:, -params.k]
                    useful = product >= np.maximum(kth, self.best[some][:, -1])[:, None]
                    columns = np.flatnonzero(useful.any(axis=0))
                else:
                    columns = np.arange(product.shape[1])
                if len(columns):
                    found_ids = np.broadcast_to(ids[columns], (len(some), len(columns)))
                    self.best[some], self.best_ids[some] = _merged(
                        self.best[some], self.best_ids[some], product[:, columns], found_ids, params.k
                    )

        def result(self):
            if not self.ready or not self.ids:
                return None
            there = self.best_ids != np.iinfo(np.int64).max
            there &= np.array(self.best != -np.inf, bool)
            at, _ = np.nonzero(there)
            score = [int(s) for s in self.best[there]]
            return pa.RecordBatch.from_arrays(
                [pa.array(self.id[at]), pa.array(self.best_ids[there]), pa.array(score, pa.int64())],
                names=[name for name, _ in found_type],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lane = None, Lane()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([_column(batch, "query_group"), _column(batch, "lane")], axis=1)
            turns = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for begin, end in zip([0, *turns], [*turns, len(keys)]):
                part = batch.slice(begin, end - begin)
                if now is not None and tuple(keys[begin]) != now:
                    if (done := lane.result()) is not None:
                        yield done
                    lane = Lane()
                now = tuple(keys[begin])
                vecs, ids = _matrix(part, "vec", width), _column(part, "vec_id")
                kinds = _column(part, "is_point")
                queries = np.flatnonzero(~kinds.astype(bool))
                points = np.flatnonzero(kinds.astype(bool))
                if len(queries):
                    lane.add_queries(ids[queries], vecs[queries], _column(part, "floor_score")[queries])
                if len(points):
                    cells, radii = _column(part, "cell"), _column(part, "radius")
                    lane.search(ids[points], vecs[points], cells[points], radii[points])
        if (done := lane.result()) is not None:
            yield done

    return run


def build_index(vectors: DataFrame, params: TopKParams) -> tuple[DataFrame, Space, int] | None:
    """The stored index (INDEX columns and ``part``), its space, and the width of the vectors."""
    squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    width, largest = vectors.agg(F.max(F.size("vec")), F.max(squares)).first()
    if width is None:
        return None
    # a bounded sample, the same for every run, without copies of one vector
    sample = vectors.groupBy("vec").agg(F.min("vec_id").alias("vec_id"))
    sample = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(params.pivots).collect()
    pivots = np.zeros((len(sample), max(width, 1)))
    for at, row in enumerate(sample):
        pivots[at, : len(row["vec"])] = row["vec"]
    width = pivots.shape[1]
    space = Space(pivots, float(largest))
    keyed = vectors.mapInArrow(indexer(space, width), f"{VECTOR}, cell int, radius double")
    order = ["cell", "radius", "vec_id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    searched = placed.mapInArrow(home_searcher(params, width), INDEX)
    index = stored(searched.withColumn("part", F.spark_partition_id()), "topk-index")
    return index, space, width


def top_k(
    vectors: DataFrame,
    query: F.Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    params: TopKParams | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query row.

    Components count as floor(scale * x). Candidates are all rows but the query's own id; ties go to the smaller
    id. Null ids, null vectors and vectors that hold null or non-finite components take no part, neither as query
    nor as candidate; a null ``query`` is false. Vectors of different length meet
    over their common components. Of rows repeated with one id each is a candidate; as a
    query the id counts once. An empty table gives an empty result.
    """
    params = params or TopKParams()
    spark = vectors.sparkSession
    base = stored(whole_vectors(vectors, vec_id, embedding, query, params.scale), "topk-vectors")
    built = build_index(base, params)
    schema = "query_id long, vec_id long, score long"
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, space, width = built
    parts, points, queries = index.agg(F.max("part"), F.count("*"), F.count_if("is_query")).first()
    groups = max(1, -(-queries // params.group_size))
    lanes = max(1, -(-points // params.lane_size))
    # neighbouring index parts make one group of queries and one lane of points
    group = F.floor(F.col("part") * groups / (parts + 1)).cast("int").alias("query_group")
    lane = F.floor(F.col("part") * lanes / (parts + 1)).cast("int").alias("lane")
    asked = index.where("is_query").dropDuplicates(["vec_id"]).select("vec_id", "vec", "floor_score", group)
    limits = asked.mapInArrow(
        group_bounds(space, params, width), "query_group int, cell int, low double, high double"
    )
    limits = limits.groupBy("query_group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    near = F.col("radius").between(F.col("low"), F.col("high"))
    met = index.select("vec_id", "vec", "cell", "radius", lane).join(limits, "cell").where(near)
    # an annulus is read from the distance outwards at which the group's queries lie
    middle = (F.col("low") + F.col("high")) / 2
    point_rows = met.select(
        "query_group",
        "lane",
        F.lit(True).alias("is_point"),
        F.when(F.isnan(middle), 0.0).otherwise(F.abs(F.col("radius") - middle)).alias("turn"),
        "vec_id",
        "vec",
        "cell",
        "radius",
        F.lit(0.0).alias("floor_score"),
    )
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    query_rows = asked.select(
        "query_group",
        every_lane,
        F.lit(False).alias("is_point"),
        F.lit(-1.0).alias("turn"),
        "vec_id",
        "vec",
        F.lit(0).alias("cell"),
        F.lit(0.0).alias("radius"),
        "floor_score",
    )
    order = ["query_group", "lane", "is_point", "cell", "turn"]
    dealt = query_rows.unionByName(point_rows).repartition("query_group", "lane").sortWithinPartitions(*order)
    found = dealt.mapInArrow(lane_searcher(space, params, width), schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
