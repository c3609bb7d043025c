"""Tables in buckets of a key: joins on the key read the stored side where it lies, without a shuffle.

A table is a folder of parquet files, dealt out by the hash of its key when it is written. How it was dealt is kept by the
session's catalog, so a session that did not write the folder states key and number of buckets when it reads.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: Buckets of a table, which are also the tasks of a join with it; raise it with the table, to a gigabyte or so a bucket.
BUCKETS = 32


def _name(path: str) -> str:
    return "buckets_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, dealt: bool = False) -> DataFrame:
    """Write rows to a new folder in buckets of ``key`` and return the table.

    Rows are dealt out first, so that each bucket is one file; ``dealt`` says that they already come from a join with a
    table in as many buckets of the same key, and then nothing is shuffled.
    """
    rows = df if dealt else df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_name(path), format="parquet")
    return df.sparkSession.table(_name(path))


def read_buckets(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A folder that ``write_buckets`` filled with the same key and number of buckets, perhaps in another session."""
    name, where = _name(path), path.replace("\\", "\\\\").replace("'", "\\'")
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
            f" LOCATION '{where}'"
        )
    return spark.table(name)
