"""Helpers shared by the corpus operators: tables, scratch tables, words, free names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that a key test holds at most: 16 MB.
KEY_BITS = 1 << 27
#: Fixed value: a word is a run without blank, tab, line feed, VT, form feed or return.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared scratch folder and read again.

    Cuts the lineage: a lost executor costs a second read of these files, not the work
    before them, and every later use sees the same rows.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def sampled(
    rows: DataFrame, group: str, key: str, seed: str, sizes: dict, sample: int
) -> DataFrame:
    """At most ``sample`` rows of each group in ``sizes`` (its rows), those with the lowest hashes of ``key``.

    A cut by hash that leaves twice as many and some more comes before the shuffle, so that a large
    group is no large task.
    """
    if not sizes:
        return rows.limit(0)
    place = F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit((1 << 32) - 1))
    cuts = [
        F.lit(x) for name, n in sizes.items() for x in (name, int(min(1, (2 * sample + 100) / n) * (1 << 32)))
    ]
    near = rows.withColumn("at", place).where(F.col("at") < F.create_map(*cuts)[F.col(group)])
    order = Window.partitionBy(group).orderBy("at", key)
    ranked = near.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= sample).drop("at", "rank")


def may_hold(keys: DataFrame, columns: list[str]) -> Callable[[list[Column]], Column]:
    """A test of key columns that holds for every key in ``keys`` and for few others.

    The keys' hashes are marks in a bitmap that the executors make, 32 bits a key and never more than
    ``KEY_BITS``, so it may be sent to all tasks. With more keys than it can tell apart it lets more rows
    through; it never holds one back. So rows that no key meets need not be shuffled for a join.
    """
    spark = keys.sparkSession
    bits = min(KEY_BITS, max(1 << 15, 1 << (32 * max(1, keys.count()) - 1).bit_length()))

    def place(given: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*given), F.lit(bits))

    number = place([F.col(c) for c in columns]) + 1
    marks = keys.select(F.bitmap_bucket_number(number).alias("part"), F.bitmap_bit_position(number).alias("at"))
    parts = marks.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    blank = F.unhex(F.repeat(F.lit("00"), F.lit(4096)))
    blanks = spark.range(1, bits // 32768 + 1).select(F.col("id").alias("part"), blank.alias("bits"))
    parts = parts.unionByName(blanks).groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    ordered = parts.agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("parts"))
    bitmap = stored(ordered.select(F.transform("parts", lambda x: x["bits"]).alias("bits")), "key-bits").scalar()

    def test(given: list[Column]) -> Column:
        at = place(given)
        part = F.element_at(bitmap, (F.shiftright(at, 15) + 1).cast("int"))
        inside = at.bitwiseAND(F.lit(32767)).cast("int")
        byte = F.substring(part, F.shiftright(inside, 3) + 1, F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), inside.bitwiseAND(F.lit(7))) == 1

    return test


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, lengthened until no column in ``taken`` has that name in any case."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def _marked(docs: DataFrame, doc_id: str, text: str, more: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its key columns under free names; keys by the name a decision has."""
    columns = [F.col(doc_id).cast("long"), *text_key(F.col(text)), *map(F.col, more)]
    names: dict[str, str] = {}
    for wanted in ["doc_id", "text_a", "text_b", *more]:
        names[wanted] = free_name([*docs.columns, *names.values()], f"key_{wanted}")
    return docs.withColumns(dict(zip(names.values(), columns))), names


def _same(docs: DataFrame, names: dict[str, str], keys: DataFrame) -> Column:
    parts = [docs[own].eqNullSafe(keys[name]) for name, own in names.items()]
    return reduce(Column.__and__, parts)


def _one_each(marked: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """One row of each key; the first one of a task is all that is shuffled."""
    row = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row")
    return marked.groupBy(*names.values()).agg(row)


def kept_rows(docs: DataFrame, decided: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that were decided to stay, with all their columns.

    ``decided`` has one row per row of ``docs``: doc_id, text_a, text_b, kept. Documents are told
    by id and text, so no copy of the table with row numbers is needed. Where rows repeat both and
    one of them is to stay, any one does.
    """
    marked, names = _marked(docs, doc_id, text, [])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = decided.groupBy(*names).agg(F.count_if("kept").alias("stay"), F.count("*").alias("rows"))
    partly = stored(keys.where("stay < rows"), "dropped-keys")
    if partly.isEmpty():
        return docs.select(*columns)
    # only rows that may be dropped are shuffled with their texts
    hit = may_hold(partly, list(names))([F.col(own) for own in names.values()])
    near = marked.where(hit)
    left = near.join(partly, _same(near, names, partly), "left_anti").select(*columns)
    kept = marked.where(~hit).select(*columns).unionByName(left)
    repeated = partly.where("stay > 0")
    if repeated.isEmpty():
        return kept
    few = near.join(repeated, _same(near, names, repeated), "left_semi")
    one = _one_each(few, names, docs.columns).select("row.*")
    return kept.unionByName(one)


def repeated_rows(
    docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", more: list[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` (doc_id, text_a, text_b, ``more``, times) says.

    Rows that repeat all of the key share their times.
    """
    marked, names = _marked(docs, doc_id, text, more or [])
    times = free_name(marked.columns, "key_times")
    keys = plan.groupBy(*names).agg(F.sum("times").cast("int").alias(times), F.count("*").alias("rows"))
    keys = stored(keys.where(F.col(times) > 0), "row-times")
    copies = F.explode(F.sequence(F.lit(1), F.col(times)))
    single, many = keys.where("rows = 1"), keys.where("rows > 1")
    copy = free_name([*marked.columns, times], "key_copy")
    met = marked.join(single, _same(marked, names, single)).withColumn(copy, copies)
    out = met.select(*[marked[f"`{c}`"] for c in docs.columns])
    if many.isEmpty():
        return out
    few = marked.join(many, _same(marked, names, many), "left_semi")
    one = _one_each(few, names, docs.columns)
    taken = many.select(*[F.col(name).alias(own) for name, own in names.items()], times)
    same = reduce(Column.__and__, [one[own].eqNullSafe(taken[own]) for own in names.values()])
    more_rows = one.join(taken, same).withColumn(copy, copies).select("row.*")
    return out.unionByName(more_rows)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
