"""A chunk index that is kept: only the chunks of changed documents are embedded again.

Below ``root`` lie two append-only tables. ``chunks`` holds embedded chunks with the run that
made them, ``state`` one row per document and run in which its text changed: the text's digest, or
NULL once the document is gone. A document's current chunks are those of its last run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators.documents import index_chunks
from ledgerspark.schemas import CHUNKS, table_schema
from ledgerspark.session import stored
from ledgerspark.sources.tables import append_batch, read_facts

KEY = ["workspace_id", "document_id"]
STATE = table_schema("workspace_id string, document_id string, digest string, run bigint")
MADE = T.StructType([*CHUNKS.fields, T.StructField("run", T.LongType())])


def current_documents(spark: SparkSession, root: str) -> DataFrame:
    """Digest and run of every document that the index holds."""
    state = read_facts(spark, f"{root}/state", STATE)
    last = state.groupBy(*KEY).agg(F.max_by(F.struct("digest", "run"), "run").alias("last"))
    return last.select(*KEY, "last.*").filter(F.col("digest").isNotNull())


def refresh_index(spark: SparkSession, root: str, documents: DataFrame, column: str = "summary") -> int:
    """Brings the index up to ``documents``; returns the number of the run.

    Documents are compared by the digest of their text, one small row each. New and changed
    ones are embedded; documents that are no longer there leave the index. The state is
    written last, so a run that failed is not seen and its repetition replaces what it wrote.
    """
    state = read_facts(spark, f"{root}/state", STATE)
    run = (state.agg(F.max("run")).first()[0] or 0) + 1
    digest = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    given = documents.select(*KEY, digest.alias("digest"))
    known = current_documents(spark, root).select(*KEY, F.col("digest").alias("_known"))
    met = given.join(known, KEY, "full_outer")
    changed = met.filter(~F.col("digest").eqNullSafe(F.col("_known"))).select(*KEY, "digest")
    changed = stored(changed.withColumn("run", F.lit(run).cast("bigint")), "changed-documents")
    texts = documents.select(*KEY, column).join(changed.filter("digest is not null"), KEY, "left_semi")
    fresh = index_chunks(texts, column).withColumn("run", F.lit(run).cast("bigint"))
    append_batch(fresh.select([f.name for f in MADE]), f"{root}/chunks", f"run-{run}", KEY)
    append_batch(changed, f"{root}/state", f"run-{run}", KEY)
    return run


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Current chunks of every document, with their vectors."""
    chunks = read_facts(spark, f"{root}/chunks", MADE)
    current = current_documents(spark, root).select(*KEY, "run")
    return chunks.join(current, [*KEY, "run"], "left_semi").drop("run")
