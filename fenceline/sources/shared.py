"""Intermediate tables in the folder every executor can reach.

A long plan that several branches read is written once as parquet and read back. That cuts the
lineage, survives lost executors, and gives later branches column pruning and pushed filters.
"""

import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _fallback_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="fenceline-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver's own process may leave it unset and gets a temporary
    folder; on a cluster the executors would each write to a disk of their own, so that is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _fallback_dir(spark.sparkContext.applicationId)


#: Folders handed out so far, by application.
_HANDED_OUT: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/fenceline-{app}/{label}-{uuid.uuid4().hex[:12]}"
    _HANDED_OUT.setdefault(app, []).append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Intermediate tables of the block are removed at its end, but for those added to the list that it is given."""
    handed_out = _HANDED_OUT.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(handed_out), []
    try:
        yield kept
    finally:
        for path in handed_out[before:]:
            if path not in kept:
                remove(spark, path)
        handed_out[before:] = kept


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, by the library that Spark itself reads and writes with."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; a path that is not there is no error."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders right below a path."""
    system, where = _file_system(spark, path)
    if not system.exists(where):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(where) if s.isDirectory())
