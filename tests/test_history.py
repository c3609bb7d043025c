import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from test_incidents import NOW, flagged

from fenceline.operators import incidents as inc
from fenceline.operators import workflow as work
from fenceline.plans import history
from fenceline.sources import buckets
from fenceline.sources.shared import new_path

LATER = NOW + dt.timedelta(days=1)
CHANGES = "incident_id string, change_id int, changed_at timestamp, status string, assignee string, resolution_reason string"


def shuffles(df):
    """Shuffles of a plan before any of it has run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning", plan)), plan


def same(a, b):
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_history_in_buckets(spark, no_broadcast):
    path = new_path(spark, "run")
    inc.run_incidents(inc.incident_groups(flagged(spark))).write.parquet(path)
    run = spark.read.parquet(path)
    existing = inc.new_incidents(run, F.lit(NOW)).filter("store_id <> 'C'")
    existing = existing.withColumn("status", F.when(F.col("store_id") == "A", "resolved").otherwise("open"))
    existing = existing.withColumn("severity_score", F.lit(1.0))
    old, new, newest = (new_path(spark, "history") for _ in range(3))
    history.store_incidents(existing, old, 8)

    # A run: only its own rows are shuffled, once for the join.
    stored = history.stored_incidents(spark, old, 8)
    count, plan = shuffles(inc.merge_incidents(stored, run, F.lit(LATER)))
    assert count == 1 and "Bucketed: true" in plan
    merged = history.merge_run(spark, old, run, F.lit(LATER), new, 8)
    assert same(merged, inc.merge_incidents(existing, run, F.lit(LATER)).drop("change"))

    # A batch of requests, read as another session would: without an entry in the catalog.
    spark.sql(f"DROP TABLE {buckets._name(new)}")
    first = run.first()["dedup_key"]
    changes = spark.createDataFrame([(first, 1, NOW, "acknowledged", "someone", None), (first, 2, LATER, None, "", "why")], CHANGES)
    stored = history.stored_incidents(spark, new, 8)
    by_request = shuffles(work.apply_changes(stored, changes))[0]
    plain = spark.read.parquet(new).withColumn("incident_id", F.col("dedup_key"))
    assert by_request <= shuffles(work.apply_changes(plain, changes))[0] - 2  # neither of both joins shuffles the history
    after = history.merge_changes(spark, new, changes, newest, 8)
    assert same(after, work.apply_changes(spark.read.parquet(new), changes))
    # Each bucket is one file, although nothing was dealt out again on the way.
    files = after.select(F.input_file_name().alias("f"), F.pmod(F.hash("dedup_key"), F.lit(8)).alias("b")).distinct().collect()
    assert len({r["b"] for r in files}) == len(files)


def test_empty_history_and_empty_run(spark):
    run = inc.run_incidents(inc.incident_groups(flagged(spark)))
    nothing, old, new, newest = run.limit(0), *(new_path(spark, "history") for _ in range(3))
    history.store_incidents(inc.new_incidents(nothing, F.lit(NOW)), old, 4)
    first = history.merge_run(spark, old, run, F.lit(NOW), new, 4)
    assert same(first, inc.new_incidents(run, F.lit(NOW)))
    assert same(history.merge_run(spark, new, nothing, F.lit(LATER), newest, 4), first)


def test_another_id_is_an_error(spark):
    rows = inc.new_incidents(inc.run_incidents(inc.incident_groups(flagged(spark))), F.lit(NOW))
    with pytest.raises(Exception, match="id of an incident is not its key"):
        history.store_incidents(rows.withColumn("incident_id", F.lit("other")), new_path(spark, "history"), 4)
