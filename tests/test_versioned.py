import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fenceline.plans.daily import run_detection, run_range, store_run
from fenceline.sources.versioned import StaleVersion, UnknownTable, VersionedTables

SCHEMA = "date date, store_id string, n long"
JAN = dt.date(2024, 1, 1)


def day(n):
    return JAN + dt.timedelta(days=n)


def rows(spark, days, n=0, stores="AB"):
    return spark.createDataFrame([(day(d), s, n) for d in days for s in stores], SCHEMA)


def found(df):
    return sorted((r["date"], r["store_id"], r["n"]) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    return VersionedTables(spark, str(tmp_path / "tables"))


def put(tables, df, first, last):
    change = tables.begin()
    change.replace_range("t", df, day(first), day(last), ("store_id",))
    return change.commit()


def test_a_vanished_date_goes_and_old_versions_stay(spark, tables):
    assert tables.current() == 0 and not tables.has("t")
    with pytest.raises(UnknownTable):
        tables.read("t")
    assert put(tables, rows(spark, range(90)), 0, 89) == 1
    assert put(tables, rows(spark, [30, 32, 200], 7), 30, 34) == 2  # 31, 33 and 34 are gone, 200 is outside
    wanted = [(day(d), s, 7 if d in (30, 32) else 0) for d in range(90) if d not in (31, 33, 34) for s in "AB"]
    assert found(tables.read("t")) == sorted(wanted)
    assert len(found(tables.read("t", version=1))) == 180
    assert found(tables.read("t", first=day(29), last=day(32))) == sorted(w for w in wanted if day(29) <= w[0] <= day(32))
    # A span without any new row empties these dates; one over everything leaves nothing else.
    put(tables, rows(spark, []), 0, 9)
    assert min(r[0] for r in found(tables.read("t"))) == day(10)
    put(tables, rows(spark, [5], 1), -50, 500)
    assert found(tables.read("t")) == [(day(5), "A", 1), (day(5), "B", 1)] and len(tables.segments()) == 1


def test_clipped_segments_against_a_plain_table(spark, tables):
    rng, state = random.Random(3), {}
    for version in range(6):
        first = rng.randint(0, 60)
        last = first + rng.randint(0, 40)
        days = [d for d in range(first, last + 1) if rng.random() < 0.7]
        put(tables, rows(spark, days, version), first, last)
        state = {d: v for d, v in state.items() if not first <= d <= last} | dict.fromkeys(days, version)
    wanted = sorted((day(d), s, v) for d, v in state.items() for s in "AB")
    assert found(tables.read("t")) == wanted
    change = tables.begin()
    change.compact("t", ("store_id",))
    change.commit()
    assert found(tables.read("t")) == wanted and len(tables.segments()) == 1


def test_a_failed_run_leaves_nothing(spark, tables):
    put(tables, rows(spark, range(10)), 0, 9)
    change = tables.begin()
    change.replace_range("t", rows(spark, range(5), 1), day(0), day(9))
    broken = rows(spark, range(3)).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        change.snapshot("incidents", broken)
    assert tables.current() == 1 and not tables.has("incidents") and len(found(tables.read("t"))) == 20
    # A commit that was lost while it wrote its manifest leaves a folder without rows.
    spark.createDataFrame([], "version bigint").write.json(f"{tables.root}/manifests/{2:012d}")
    assert tables.current() == 1
    assert put(tables, rows(spark, [3], 5), 3, 3) == 2
    assert tables.vacuum() >= 2  # the folders of the lost run
    assert len(found(tables.read("t"))) == 20 and tables.current() == 2
    with pytest.raises(UnknownTable):
        tables.read("t", version=1)


def test_two_changes_from_one_version(spark, tables):
    one, two = tables.begin(), tables.begin()
    one.snapshot("a", rows(spark, [1]))
    two.append("b", rows(spark, [1]))
    one.commit()
    with pytest.raises(StaleVersion):
        two.commit()
    three = tables.begin()
    three.append("b", rows(spark, [1]))
    three.append("b", rows(spark, [2]))
    three.snapshot("a", rows(spark, []))
    three.commit()
    assert len(found(tables.read("b"))) == 4 and tables.read("a").count() == 0


def test_readers_skip_months(spark, tables):
    put(tables, rows(spark, range(366), stores=[f"s{k:02d}" for k in range(20)]), 0, 365)
    seen = tables.read("t", first=day(40), last=day(45)).where("store_id = 's03'")
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part_month" in plan and "PushedFilters: [IsNotNull(date)" in plan
    assert "isnotnull(store_id" in plan and seen.count() == 6


# --- runs into versioned tables --------------------------------------------------------------------

RAW = (
    "date date, store_id string, sku_id string, on_hand int, sold int, delivered int, returned int, price double, "
    "promo_flag boolean"
)
AS_OF = dt.datetime(2024, 6, 1)


def history(spark, days, seed=4, gap=None):
    rng, out = random.Random(seed), []
    for d in range(days):
        for store in "ABC":
            for sku in "xyz":
                values = (rng.randint(0, 30), rng.randint(0, 9), rng.random())
                # Some pairs have gaps, longer than a window for one of them.
                if values[2] < 0.25 or (store + sku == "Cz" and 20 <= d < 55) or (gap and (d in gap)):
                    continue
                sold = 500 if rng.random() < 0.02 else values[1]
                out.append((day(d), store, sku, values[0], sold, 0, 0, 2.0, False))
    return spark.createDataFrame(out, RAW)


def compare(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


DETECTED = ["detection_id", "actual_value", "q1", "q3", "is_outlier", "sample_size", "fallback_used"]
FEATURES = ["date", "store_id", "sku_id", "sold", "prev_day_number", "sold_rolling_mean", "on_hand_rolling_std", "delta_on_hand"]


def test_runs_over_spans_equal_one_full_run(spark, tables):
    raw = history(spark, 75).cache()
    whole = run_detection(raw, F.lit(AS_OF), with_forest=False)
    for first, last in ((0, 31), (32, 33), (34, 60), (61, 74)):
        run = run_range(tables, raw, F.lit(AS_OF), day(first), day(last))
        store_run(tables, run, day(first), day(last))
    assert str(compare(tables.read("features"), FEATURES)) == str(compare(whole.features, FEATURES))
    assert str(compare(tables.read("detections"), DETECTED)) == str(compare(whole.detections, DETECTED))
    told = ["dedup_key", "date", "severity_score", "headline", "sku_count", "status"]
    assert compare(tables.read("incidents"), told) == compare(whole.incidents, told)
    assert tables.read("items").count() == whole.items.count() and tables.read("notes").count() == whole.notes.count()


def test_rerun_of_an_older_span_with_a_vanished_date(spark, tables):
    raw, cut = history(spark, 60).cache(), {40, 41}
    store_run(tables, run_range(tables, raw, F.lit(AS_OF), day(0), day(59)), day(0), day(59))
    known = tables.read("incidents").count()
    before = compare(tables.read("features", first=day(43)), FEATURES)
    again = raw.where(~F.col("date").isin([day(d) for d in cut]))
    store_run(tables, run_range(tables, again, F.lit(AS_OF), day(38), day(42)), day(38), day(42))
    for name in ("features", "detections"):
        dates = {r["date"] for r in tables.read(name, first=day(38), last=day(42)).select("date").distinct().collect()}
        assert dates == {day(38), day(39), day(42)}
    # What was detected there is as in a run that never had the dates; what lies behind is untouched.
    wanted = run_detection(again.where(F.col("date") <= F.lit(day(42))), F.lit(AS_OF), with_forest=False)
    span = F.col("date").between(F.lit(day(38)), F.lit(day(42)))
    assert str(compare(tables.read("detections", first=day(38), last=day(42)), DETECTED)) == str(compare(wanted.detections.where(span), DETECTED))
    assert str(compare(tables.read("features", first=day(43)), FEATURES)) == str(before)
    # Incidents and their notes are never taken back, and the earlier version is still there.
    assert tables.read("incidents").count() >= known
    assert tables.read("features", version=1).where(F.col("date") == F.lit(day(40))).count() > 0
    tail = {(r["store_id"], r["sku_id"]): r["date"] for r in tables.read("tail").collect()}
    latest = tables.read("features").groupBy("store_id", "sku_id").agg(F.max("date").alias("date")).collect()
    assert tail == {(r["store_id"], r["sku_id"]): r["date"] for r in latest}
