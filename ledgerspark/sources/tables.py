"""Stored ledger tables on plain parquet.

Facts are appended in named batches: writing a batch again replaces it, so a job or a
streaming batch that is repeated after a failure changes nothing. Latest-state tables are
written as whole new versions; readers follow a pointer that is added after the data.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("path", T.StringType())]
)


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_batch(rows: DataFrame, path: str, batch_id: str, cluster_by: list[str] = ()) -> None:
    """Add rows to a fact table as one batch; the same batch id replaces its rows, also by none.

    Rows are clustered by ``cluster_by`` inside the batch, so that later reads of some
    workspaces or days skip row groups. The range partitioning splits a large workspace
    over many files, which a directory per workspace would not; with a row's id as the last
    column it splits a large day as well.
    """
    if cluster_by:
        rows = rows.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={quote(batch_id, safe='')}")


def read_facts(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    skip_batch: str | None = None,
    workspace_id: str | None = None,
) -> DataFrame:
    """Rows of a fact table, empty when it does not exist yet.

    With ``workspace_id`` the scan skips the row groups of other workspaces, which a table
    written with ``cluster_by`` keeps apart.
    """
    batch = T.StructField("batch_id", T.StringType())
    stored = _read_or_empty(spark, path, T.StructType([*schema.fields, batch]))
    if skip_batch is not None:
        stored = stored.filter(F.col("batch_id") != skip_batch)
    if workspace_id is not None:
        stored = stored.filter(F.col("workspace_id") == workspace_id)
    return stored.drop("batch_id")


class VersionedTable:
    """Latest-state table: immutable versions below ``root`` and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def _current(self):
        pointers = _read_or_empty(self.spark, f"{self.root}/_current", POINTER)
        return pointers.orderBy(F.col("version").desc()).first()

    def read(self) -> DataFrame:
        current = self._current()
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(current["path"])

    def replace(self, rows: DataFrame) -> int:
        """Write rows as the next version and point readers to it.

        A version is never written over while it is read; an unfinished one has no pointer.
        """
        current = self._current()
        version = 1 if current is None else current["version"] + 1
        path = f"{self.root}/version={version}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(columns).write.mode("overwrite").parquet(path)
        pointer = self.spark.createDataFrame([(version, path)], POINTER)
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/_current")
        return version


def store_import_job(jobs: DataFrame, rows: DataFrame, root: str, batch_id: str) -> None:
    """Staging sink: payload rows first, the job rows that make them visible last."""
    append_batch(rows, f"{root}/import_job_rows", batch_id, ["workspace_id", "job_id", "row_index"])
    append_batch(jobs, f"{root}/import_jobs", batch_id)
