"""Ledger files, documents and masked copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import fixed_values as V
from ledgerspark import schemas
from ledgerspark.functions.masking import mask_columns, mask_json_text
from ledgerspark.operators import imports
from ledgerspark.operators.keyed import lookup_join, running_total
from ledgerspark.session import folder_groups, folders_listed_together, scratch_path, small_files_packed, stored


# one part of a file, and every million rows of it
UPLOAD_BLOCKS = ["row_order.block", "row_order.million"]

CSV = {"header": True, "inferSchema": False, "enforceSchema": True, "escape": '"'}


def header_cells(line: Column) -> Column:
    """Cells of a header line; commas inside quotes part nothing, doubled quotes stand for one."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = F.transform(cells, lambda c: F.regexp_replace(c, r'^"(.*)"$', "$1"))
    return F.transform(bare, lambda c: F.replace(c, F.lit('""'), F.lit('"')))


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``headers`` of every file below ``path``, one small row each.

    The header is the first line that is not blank; it does not hold line breaks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
    )
    heads = lines.filter(F.trim("line") != "").groupBy("file").agg(F.min_by("line", "at").alias("head"))
    return heads.select("file", header_cells(F.col("head")).alias("headers"))


def read_uploads(
    spark: SparkSession,
    path: str,
    workspace_id: str,
    import_type: str,
    quoted_breaks: bool = True,
) -> DataFrame:
    """Files of any layouts as uploaded rows, in one scan; every file is one import job.

    Every cell is text: a sku such as 007 stays as written. Cells are read by position, as many as
    the widest header has, and a file's headers say which of them its fields take; so headers may repeat, differ
    only in case, or look like helper columns. Cells beyond a file's headers are left out, cells that a row lacks are
    empty. The headers are joined to the rows by file, a row each, so the number of files and
    of layouts is not bounded; only the width of the widest header comes to the driver.

    Line breaks inside quotes make a file one task; without them (``quoted_breaks=False``)
    files are split. Without any header line below ``path`` a ValueError is raised.
    """
    heads = stored(
        csv_headers(spark, path).withColumn("places", imports.field_places(import_type, F.col("headers"))),
        "csv-headers",
    )
    width = heads.agg(F.max(F.size("headers"))).first()[0]
    if width is None:
        raise ValueError(f"no CSV file with a header line below {path}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.options(**CSV, multiLine=quoted_breaks).schema(schema).csv(path)
    number = F.monotonically_increasing_id()
    rows = raw.select(
        F.array(*schema.names).alias("cells"),
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.shiftright(number, 20).alias("million"),
            number.alias("row"),
        ).alias("row_order"),
    )
    met = lookup_join(rows, heads, ["file"], ["row_order"], how="inner")
    return met.select(
        F.lit(workspace_id).alias("workspace_id"),
        F.sha2(F.concat_ws("\x1f", F.lit(workspace_id), "file"), 256).substr(1, 32).alias("job_id"),
        F.lit(import_type).alias("import_type"),
        F.regexp_extract("file", "[^/]+$", 0).alias("filename"),
        "row_order",
        "headers",
        imports.payload_at(import_type, F.col("cells"), F.col("places")).alias("payload"),
    )


def read_document_json(spark: SparkSession, path: str) -> DataFrame:
    """Array files of documents with a fixed schema."""
    rows = spark.read.schema(schemas.DOCUMENT_FILE).option("multiLine", True).json(path)
    return rows.select(
        "title", "kind", "summary", F.to_date("uploadedAt").alias("uploaded_at")
    )


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]+$", 0))


def document_summary(name: Column, content: Column) -> Column:
    """Summary by file kind: leading text, column names, or a fixed sentence."""
    suffix = _suffix(name)
    first_line = F.regexp_extract(content, r"^[^\r\n]*", 0)
    header = F.array_join(header_cells(first_line), ", ")
    return (
        F.when(suffix.isin(".txt", ".md"), F.substring(content, 1, V.SUMMARY_CHARS))
        .when(suffix == ".csv", F.concat(F.lit(V.TABULAR_SUMMARY), header))
        .otherwise(V.OTHER_SUMMARY)
    )


def read_documents(
    spark: SparkSession, path: str, workspace_id: str, kind: str, uploaded_at
) -> DataFrame:
    """Every file below ``path`` as a document with its summary.

    ``content`` is the whole text of text and table files; the summary shows the start.
    """
    with folders_listed_together(spark):
        files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", "[^/]+$", 0)
    # bytes that are no valid UTF-8 become U+FFFD and are left out
    valid = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.replace(valid, F.lit("\ufffd"), F.lit(""))
    day = F.lit(uploaded_at).cast("date")
    return files.select(
        F.lit(workspace_id).alias("workspace_id"),
        F.sha2(F.concat_ws("\x1f", F.lit(workspace_id), "path"), 256)
        .substr(1, 32)
        .alias("document_id"),
        name.alias("title"),
        F.lit(kind).alias("kind"),
        document_summary(name, text).alias("summary"),
        day.alias("uploaded_at"),
        F.col("modificationTime").alias("created_at"),
        F.when(_suffix(name).isin(".txt", ".md", ".csv"), text).alias("content"),
    )


def _cut(size: int):
    """Pieces of files that are read whole, and runs of text of the other parts; see ``read_document_chunks``."""

    # all in one function, so that executors need no copy of this package
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, number = None, "", 0

        def rows(texts: list[str]) -> pa.RecordBatch:
            count = len(texts)
            columns = [[key[0]] * count, [key[2]] * count, [key[1]] * count, range(number, number + count), texts]
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["document_id", "whole", "block", "number", "content"]
            )

        for batch in batches:
            ids, blocks = batch.column("document_id"), batch.column("block").to_numpy()
            codes = ids.dictionary_encode().indices.to_numpy()
            new = (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])
            starts = np.flatnonzero(np.r_[True, new]) if len(codes) else []
            for start, end in zip(starts, [*starts[1:], len(codes)]):
                place = (ids[start].as_py(), int(blocks[start]), batch.column("whole")[start].as_py())
                if place != key:
                    if key and rest.strip(" "):
                        yield rows([rest.strip(" ")])
                    key, rest, number = place, "", 0
                # white space of Python is that of collapse_spaces
                text = " ".join("\n".join(batch.column("line")[start:end].to_pylist()).split())
                if not text:
                    continue
                step = size if key[2] else size * 256
                text = rest + text + " "
                stop = len(text) // step * step if key[2] else len(text)
                pieces, rest = [text[i : i + step] for i in range(0, stop, step)], text[stop:]
                if pieces:
                    yield rows([p.strip(" ") for p in pieces] if key[2] else pieces)
                number += len(pieces)
        if key and rest.strip(" "):
            yield rows([rest.strip(" ")])

    return cut


def read_document_chunks(
    spark: SparkSession, path: str, workspace_id: str, size: int = V.CHUNK_CHARS
) -> DataFrame:
    """Chunks of every text and table file below ``path``, without a file ever being one cell.

    Equal to the chunks of ``read_documents``' content. Files are read once, line by line, many small ones in a task, and a
    group of folders after the other. A task that reads a whole file cuts it as the lines come. Of a file read by many tasks they keep runs
    of text with white space collapsed; the characters of the runs before, a running total over the parts of the file, tell which
    pieces a run has a share in, and a piece is put together from at most ``size`` shares. A line is one cell, and a
    byte order mark at the start of a file goes. ``size`` is 2 or more.
    """
    if size < 2:
        raise ValueError("a chunk holds at least two characters")
    target = scratch_path(spark, "file-chunks")
    # the name as ``binaryFile`` has it
    name = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    bare = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    schema = "document_id string, whole boolean, block bigint, number bigint, content string"
    for group in folder_groups(spark, path):
        reader = spark.read if group == [path] else spark.read.option("basePath", path)
        with folders_listed_together(spark), small_files_packed(spark):
            lines = reader.text(group).filter(_suffix(F.regexp_extract(name, "[^/]+$", 0)).isin(".txt", ".md", ".csv"))
            block, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
            marked = lines.select(
                F.sha2(F.concat_ws("\x1f", F.lit(workspace_id), name), 256).substr(1, 32).alias("document_id"),
                block.alias("block"),
                ((block == 0) & (length == F.col("_metadata.file_size"))).alias("whole"),
                bare.alias("line"),
            )
            marked.mapInArrow(_cut(size), schema).write.mode("append").parquet(target)
    cut = spark.read.schema(schema).parquet(target)
    columns = [F.lit(workspace_id).alias("workspace_id"), "document_id", "chunk_index", "content"]
    number = F.col("number").cast("int").alias("chunk_index")
    pieces = cut.filter("whole").select("document_id", number, "content").select(*columns)
    runs = cut.filter("not whole").withColumn("span", F.length("content"))
    if runs.isEmpty():
        return pieces
    placed = running_total(runs, ["document_id"], ["number"], "span", "start", ["block"])
    # the share of the piece that the run starts in, then whole pieces, cut in one pass
    room = (F.lit(size) - F.col("start") % size).cast("int")
    rest = F.regexp_extract_all(F.substring("content", room + 1, F.col("span")), F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))
    shares = placed.select(
        "document_id",
        "start",
        F.floor(F.col("start") / size).alias("first"),
        F.posexplode(F.concat(F.array(F.substring("content", F.lit(1), room)), rest)).alias("n", "share"),
    )
    piece = (F.col("first") + F.col("n")).cast("int").alias("chunk_index")
    parts = shares.groupBy("document_id", piece).agg(F.array_sort(F.collect_list(F.struct("start", "share"))).alias("parts"))
    content = F.trim(F.array_join(F.transform("parts", lambda p: p["share"]), ""))
    joined = parts.select("document_id", "chunk_index", content.alias("content")).filter(F.col("content") != "")
    return pieces.unionByName(joined.select(*columns))


def write_masked_csv(
    spark: SparkSession, path: str, digits_only_in_text: bool = False, quoted_breaks: bool = True
) -> str:
    """Masked copy of a CSV file next to it; returns its path.

    As in ``read_uploads``, a file is split over tasks where no cell holds a line break
    (``quoted_breaks=False``).
    """
    raw = spark.read.options(**CSV, multiLine=quoted_breaks).csv(path)
    target = masked_path(path)
    masked = mask_columns(raw, digits_only_in_text)
    masked.write.mode("overwrite").options(header=True, escape='"').csv(target)
    return target


def write_masked_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, digits_only_in_text: bool = False
) -> str:
    """Masked copy of a JSON array file next to it; returns its path.

    Without a schema the objects may have any shape; each is masked as the text that it is.
    """
    target = masked_path(path)
    if schema is None:
        values = spark.read.options(singleVariantColumn="value", multiLine=True).json(path)
        items = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
        text = values.select(F.explode(items).alias("item")).select(F.to_json("item").alias("value"))
        text.select(mask_json_text(F.col("value"), digits_only_in_text).alias("value")).write.mode(
            "overwrite"
        ).text(target)
        return target
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    mask_columns(raw, digits_only_in_text).write.mode("overwrite").json(target)
    return target


def masked_path(path: str) -> str:
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}-sanitized.{suffix}" if dot else f"{path}-sanitized"


def create_views(tables: dict[str, DataFrame]) -> None:
    """Temp view per ledger table, for ad-hoc SQL."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
