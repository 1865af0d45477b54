"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet, not by caching: a lost executor then costs a re-read, not a re-run of the
model or of a shuffle, and later steps still prune columns.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session may fall back to a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="textcurate-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does a file, folder or glob match anything?"""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(pattern)
    return found is not None and len(found) > 0


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(folder)) if system.exists(folder) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to an unused name beside it or elsewhere in the same file system, in one step."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(source).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(paths(target).getParent())
    if system.exists(paths(target)) or not system.rename(paths(source), paths(target)):
        raise FileExistsError(f"{source} could not become {target}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch root."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/textcurate-{app}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, in one partition; unlike one made of an empty list, it starts no Python worker."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def materialize(df: DataFrame, label: str, partition_by: str | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    Readers and writers hold a Parquet row group, or 4096 rows of it: for rows of a megabyte ``group_rows`` cuts it short.
    What was shuffled for it is dropped as soon as it is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    with shuffles_dropped(spark):
        writer.parquet(path)
    # The schema is known, so reading it back starts no inference job.
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, *labels: str) -> None:
    """Delete the stored tables of these labels that ``df`` reads, once what was made of them is stored and nothing reads them again."""
    spark = df.sparkSession
    wanted = tuple(f"{label}-" for label in labels)
    # A table is one folder, and its files lie directly in it.
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    inside = f"/textcurate-{spark.sparkContext.applicationId}/"
    for folder in folders:
        if inside in folder and folder.rpartition("/")[2].startswith(wanted):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
