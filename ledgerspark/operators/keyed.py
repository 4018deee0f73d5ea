"""Keyed building blocks that stay whole and balanced when one key is hot."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import stored

SALTS = 16
#: Rows of one key from which on they are spread over several tasks.
LARGE = 1_000_000


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, ord_col: str) -> DataFrame:
    """First ``k`` rows per key, numbered from 1.

    Spark limits each task's rows per key before the shuffle, so at most ``k`` rows per
    key and task travel. ``order`` must be total for a repeatable result.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(ord_col, F.row_number().over(window)).filter(F.col(ord_col) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def with_stand_in(few: DataFrame, stand_ins: DataFrame, key: str) -> DataFrame:
    """``few``, and a key's stand-in row where it has none; ``few`` holds a handful of rows per key.

    Both go through one window, so what ``few`` is made of is read once.
    """
    marked = few.withColumn("_real", F.lit(1)).unionByName(stand_ins.withColumn("_real", F.lit(0)))
    real = F.max("_real").over(Window.partitionBy(key))
    kept = marked.withColumn("_any", real).filter(F.col("_real") == F.col("_any"))
    return kept.select(*few.columns)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
    only_used: bool = False,
) -> DataFrame:
    """Join many rows to a lookup that holds one row per key.

    A hot key's rows are spread over ``salts`` tasks by a hash of ``spread_by``; the
    lookup, one row per key, is repeated once per salt. Spark still broadcasts the lookup
    by itself when its measured size is below the broadcast threshold. ``only_used``
    reduces a lookup that may outgrow the rows to the keys they use before repeating it.
    """
    if only_used:
        lookup = lookup.join(rows.select(*on).distinct(), on, "left_semi")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def large_keys(df: DataFrame, key: list[str], rows: int = LARGE) -> DataFrame:
    """Keys with more than ``rows`` rows, counted and written down; they are few next to the rows."""
    counted = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    return stored(counted.filter(F.col("_rows") > rows).select(*key), "large-keys")


def match_rows(
    rows: DataFrame, lookup: DataFrame, on: list[str], spread_by: list[str], large: int = LARGE
) -> DataFrame:
    """Inner join of many rows to a lookup with many small keys: only keys with more than ``large`` rows are spread.

    ``lookup_join`` repeats the whole lookup, which for a key of a few rows costs more than the rows.
    ``rows`` is read twice.
    """
    hot = large_keys(rows, on, large)
    if hot.isEmpty():
        return rows.join(lookup, on)
    few = rows.join(hot, on, "left_anti").join(lookup, on)
    many = rows.join(hot, on, "left_semi")
    return few.unionByName(lookup_join(many, lookup.join(hot, on, "left_semi"), on, spread_by, "inner"))


def not_in(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is absent from ``stored``; rows hold one row per key.

    Stored keys are made distinct first: that combines on the map side, so a key repeated
    in a third of the stored rows does not end up in one task.
    """
    return rows.join(stored.select(*key).distinct(), key, "left_anti")


def number_rows(
    df: DataFrame, group: list[str], order: list[str], name: str, blocks: list[Column | str]
) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, however large a group is.

    ``blocks`` cut a group into runs: coarse values that never fall along ``order``, such as a
    day or a part of a file. Rows are numbered inside their block and raised by the rows of
    the blocks before, a running sum over one small row per block. One plan for all sizes;
    nothing runs before the result is asked for.
    """
    named = [(F.col(b) if isinstance(b, str) else b).alias(f"b{i}") for i, b in enumerate(blocks)]
    marked = df.withColumn("_block", F.struct(*named))
    key = [*group, "_block"]
    before = (
        Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        marked.groupBy(*key)
        .agg(F.count("*").alias("_rows"))
        .select(*key, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    numbered = marked.withColumn("_inside", inside).join(offsets, key)
    place = (F.col("_inside") + F.col("_offset") - 1).cast("bigint")
    return numbered.select(*df.columns, place.alias(name))


def number_in_groups(
    df: DataFrame, group: list[str], order: list[str], name: str, blocks: list[Column | str], large: int = LARGE
) -> DataFrame:
    """``number_rows`` for many small groups: only groups with more than ``large`` rows are cut into blocks.

    The others are numbered in one shuffle. ``df`` is read twice; rows without a group are left out.
    """
    df = df.na.drop(subset=group)
    hot = large_keys(df, group, large)
    place = (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint")
    if hot.isEmpty():
        return df.withColumn(name, place)
    few = df.join(hot, group, "left_anti").select(*df.columns).withColumn(name, place)
    many = df.join(hot, group, "left_semi").select(*df.columns)
    return few.unionByName(number_rows(many, group, order, name, blocks))


def running_total(
    df: DataFrame, group: list[str], order: list[str], value: str, name: str, blocks: list[str]
) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group before each row.

    As in ``number_rows``, ``blocks`` never fall along ``order``: rows are added up inside their block,
    and raised by the sums of the blocks before, one small row per block.
    """
    named = [F.col(b).alias(f"b{i}") for i, b in enumerate(blocks)]
    marked = df.withColumn("_block", F.struct(*named))
    key = [*group, "_block"]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*key).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*key, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    local = marked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    total = (F.col("_local") + F.col("_offset")).cast("bigint")
    return local.join(offsets, key).select(*df.columns, total.alias(name))


def order_blocks(df: DataFrame, order: str, name: str, rows: int = 1_000_000) -> DataFrame:
    """``df`` with runs of about ``rows`` rows along a numeric column, numbered in its order.

    The cuts are approximate quantiles over all rows, a few numbers; how exact they are shows
    in the size of the runs only.
    """
    runs = min(df.count() // rows, 10_000) + 1
    cuts: list[float] = []
    if runs > 1:
        shares = F.array(*[F.lit(i / runs) for i in range(1, runs)])
        at = F.approx_percentile(F.col(order).cast("double"), shares, F.lit(100_000))
        cuts = sorted(set(df.agg(at.alias("at")).first()["at"] or []))
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    marked = df.withColumn("_number", F.col(order).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="_number", outputCol=name, handleInvalid="keep")
    return bucketed.transform(marked).drop("_number")


def last_before(df: DataFrame, key: list[str], order: str, value: str, block: str, name: str) -> DataFrame:
    """The last value that is not NULL among the rows before each row of its key.

    ``block`` numbers runs along ``order`` (see ``order_blocks``). Rows are looked at inside their
    block; what a block ends with is carried over one small row per block, so a key
    that holds a third of all rows is spread over as many tasks as it has blocks.
    """
    inside = Window.partitionBy(*key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col(value).isNotNull(), F.col(order))
    ends = df.groupBy(*key, block).agg(F.max_by(value, given).alias("_end"))
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, block, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    local = df.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried, [*key, block]).select(*df.columns, F.coalesce("_local", "_carried").alias(name))


def number_by_range(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, by ranges of that order.

    For groups whose blocks are themselves too large for a task: rows are dealt by sampled bounds
    of (group, order), sorted inside their range, and raised by the rows of the ranges before.
    The ranges are written down, so that a lost task does not draw other ones.
    """
    rows = stored(df, "rows-to-number")
    ranges = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    runs = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered-ranges")
    runs = runs.withColumn("_part", F.shiftright("_at", 33))
    spans = runs.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    met = runs.join(spans.select(*group, "_part", shift.alias("_shift")), [*group, "_part"])
    return met.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
