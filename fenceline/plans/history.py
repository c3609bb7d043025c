"""The incident table in buckets: a run or a change log meets the history where it is stored.

Buckets go by ``dedup_key``, which is also the incident's id, so both joins find their rows without a shuffle of the
stored side, and the next table is written bucket by bucket. The tables that come in are shuffled; they are one run or
one batch of requests.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.operators.incidents import merge_incidents
from fenceline.operators.workflow import apply_changes
from fenceline.sources.buckets import BUCKETS, read_buckets, write_buckets

KEY = "dedup_key"


def _without_id(incidents: DataFrame) -> DataFrame:
    same = F.col("incident_id") == F.col(KEY)
    wrong = F.raise_error(F.concat(F.lit("id of an incident is not its key: "), F.coalesce("incident_id", F.lit("NULL"))))
    checked = F.when(same, F.col(KEY)).otherwise(wrong)
    # A separate column, so that the key itself stays the column that rows were dealt out by.
    return incidents.withColumn("incident_id", checked)


def store_incidents(incidents: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write an incident table whose ids are its keys; another id is an error."""
    return write_buckets(_without_id(incidents), path, KEY, buckets)


def stored_incidents(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return read_buckets(spark, path, KEY, buckets).withColumn("incident_id", F.col(KEY))


def merge_run(spark: SparkSession, path: str, run: DataFrame, as_of: Column, into: str, buckets: int = BUCKETS) -> DataFrame:
    """The history at ``path`` with a run merged in, written to the new folder ``into``."""
    merged = merge_incidents(stored_incidents(spark, path, buckets), run, as_of).drop("change")
    return write_buckets(merged, into, KEY, buckets, dealt=True)


def merge_changes(spark: SparkSession, path: str, changes: DataFrame, into: str, buckets: int = BUCKETS) -> DataFrame:
    """The history at ``path`` after a batch of requests, written to the new folder ``into``."""
    changed = apply_changes(stored_incidents(spark, path, buckets), changes)
    return write_buckets(changed, into, KEY, buckets, dealt=True)
