"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "ledgerspark", cpus: str = "*") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, shared by all executors.

    Only a local master without that setting falls back to a temporary folder.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="ledgerspark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique per call."""
    return f"{checkpoint_root(spark).rstrip('/')}/ledgerspark-{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written below the shared folder and read again, so that a loop's plan stays short.

    A lost executor costs a second read of these files, not the rounds before them.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Files that one read lists, about; the driver keeps 1.5 KB for each of them.
LISTED = 20_000
#: Bytes that opening a file counts for where files are packed into tasks.
OPEN_COST = 256 * 1024

#: Options of a write of very many files: on a local disk, Hadoop makes a checksum file beside each file, which takes a
#: quarter of such a write. Other file systems take no notice.
MANY_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def folders_listed_together(spark: SparkSession) -> Iterator[None]:
    """Frames that are loaded inside list many folders in a task, not one in each.

    Spark makes up to ten thousand tasks of a folder's subfolders, and every task's report goes to the driver:
    with a folder per file that is far more than the list of files.
    """
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    with _set(spark, {setting: str(min(int(spark.conf.get(setting)), 4 * spark.sparkContext.defaultParallelism))}):
        yield


@contextmanager
def small_files_packed(spark: SparkSession) -> Iterator[None]:
    """What is run inside reads many small files in a task.

    Spark counts 4 MB for opening a file, so a task takes a few files however small they are.
    """
    with _set(spark, {"spark.sql.files.openCostInBytes": str(OPEN_COST)}):
        yield


def folder_groups(spark: SparkSession, path: str, most: int | None = None) -> list[list[str]]:
    """Groups of paths that together hold what Spark reads below ``path``, each with less than twice ``most`` files.

    A folder of more than that is cut by its ``key=value`` subfolders, and a subfolder of more than that by what is in it;
    a group is read with ``path`` as its ``basePath``. A file, a pattern and a folder of few files are one group, ``path`` itself.
    """
    most = LISTED if most is None else most
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if set(path) & set("{}[]*?\\") or not store.exists(root) or not store.getFileStatus(root).isDirectory():
        return [[path]]

    def below(folder) -> Iterator:
        for found in store.listStatus(folder):
            at = found.getPath()
            name = at.getName()
            # what Spark's reader passes over
            if not name.startswith(".") and ("=" in name or not name.startswith("_")):
                if folder is not root or ("=" in name and found.isDirectory()):
                    yield at

    def weighed(folder) -> Iterator[tuple[str, int]]:
        for at in below(folder):
            count = store.getContentSummary(at).getFileCount()
            if count > most:
                yield from weighed(at)
            elif count:
                # a name, not a pattern
                yield re.sub(r"([{}\[\]*?\\])", r"\\\1", at.toString()), count

    groups: list[list[str]] = []
    held = most
    for at, count in weighed(root):
        if held >= most:
            groups.append([])
            held = 0
        groups[-1].append(at)
        held += count
    return groups if len(groups) > 1 else [[path]]
