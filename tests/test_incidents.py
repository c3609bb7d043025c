import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F
from test_tukey import RAW, daily_rows

from fenceline.operators import incidents as inc
from fenceline.operators import reports as rep
from fenceline.operators import workflow as work
from fenceline.plans.daily import DuplicateRows, run_detection

NOW = dt.datetime(2024, 6, 1, 12)
FLAGGED = (
    "date date, store_id string, sku_id string, sold_distance double, delta_distance double, by_tukey boolean, "
    "by_forest boolean, forest_reasons array<struct<feature:string,message:string>>, impact double, closeness double, tukey_flags int"
)
MON, TUE = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def flagged(spark):
    rows = [(MON, "A", "k1", 25.0, None, True, False, None, 99.0, 0.5, 1)]
    rows += [(TUE, "B", f"k{i:03d}", 10.0, -100.0, True, i == 0, [("price", "price is 2.0 std above average")] if i == 0 else None, 10.0, 1.2, 2) for i in range(500)]
    rows += [(TUE, "C", "k9", None, None, False, True, [("sold", "m1"), ("price", "m2"), ("returned", "m3")], 0.0, 0.0, 0)]
    rows += [(TUE, "A", "k1", None, -5.0, True, False, None, 1.0, 0.1, 1)]
    return spark.createDataFrame(rows, FLAGGED).repartition(5)


def test_groups(spark):
    by = {(r["date"], r["store_id"]): r for r in inc.incident_groups(flagged(spark)).collect()}
    one = by[MON, "A"]
    assert one["headline"] == "Unusual sales for k1" and one["description"] == "• k1: sold 25.0 above normal range"
    assert one["severity_score"] == pytest.approx(20 + 5 + math.log10(100) * 5 + 0.5 * 10)
    big = by[TUE, "B"]
    assert big["headline"] == "500 SKUs with anomalies in store B" and big["sku_count"] == 500
    lines = big["description"].split("\n")
    assert len(lines) == 6 and lines[-1] == "• ...and 495 more SKUs"
    assert lines[0] == "• k000: sold 10.0 above normal range; delta_on_hand 100.0 below normal range; price is 2.0 std above average"
    assert big["detectors_triggered"] == ["isolation_forest", "tukey"]
    digest = 0
    for i in range(500):
        digest ^= int(hashlib.sha256(f"k{i:03d}".encode()).hexdigest()[:15], 16)
    assert big["dedup_key"] == hashlib.sha256(f"2024-01-01_B_500_{digest}".encode()).hexdigest()[:32]
    forest = by[TUE, "C"]
    assert forest["headline"] == "sold anomaly for k9" and forest["description"] == "• k9: m1; m2"
    assert forest["severity_score"] == 25.0
    assert by[TUE, "A"]["headline"] == "Inventory anomaly for k1"


def test_store_days_that_differ_late_are_two_incidents(spark):
    rows = [(day, "D", f"k{i:02d}", 9.0, None, True, False, None, 1.0, 0.1, 1) for day, n in ((MON, 11), (TUE, 12)) for i in range(n) if i != 10 or day == TUE]
    groups = inc.incident_groups(spark.createDataFrame(rows, FLAGGED))
    assert inc.run_incidents(groups).count() == 2


def test_unknown_status_is_rejected(spark):
    incidents = inc.new_incidents(inc.run_incidents(inc.incident_groups(flagged(spark))), F.lit(NOW)).cache()
    first = incidents.first()["incident_id"]
    changes = spark.createDataFrame(
        [(first, 1, NOW, "bogus", "someone", None), (first, 2, NOW, "resolved", None, None)],
        "incident_id string, change_id int, changed_at timestamp, status string, assignee string, resolution_reason string",
    )
    after = work.apply_changes(incidents, changes).filter(F.col("incident_id") == first).first()
    assert after["status"] == "resolved" and after["assignee"] is None
    assert [r["change_id"] for r in work.invalid_changes(changes).collect()] == [1]
    assert {r["change_id"] for r in work.audit_notes(incidents, changes).collect()} == {2}


def test_earliest_creates_and_latest_scores(spark):
    run = inc.run_incidents(inc.incident_groups(flagged(spark))).cache()
    a = run.filter("store_id = 'A'").collect()
    assert len(a) == 1 and a[0]["date"] == MON and a[0]["headline"] == "Unusual sales for k1"
    assert a[0]["estimated_impact"] == 1.0 and a[0]["first_impact"] == 99.0 and a[0]["groups"] == 2
    assert inc.run_counts(run).first().asDict() == {"incidents_created": 3, "incidents_updated": 1}

    existing = inc.new_incidents(run, F.lit(NOW))
    existing = existing.withColumn("status", F.when(F.col("store_id") == "A", "resolved").otherwise("open"))
    existing = existing.filter("store_id <> 'C'").withColumn("severity_score", F.lit(1.0)).withColumn("headline", F.lit("kept"))
    later = F.lit(NOW + dt.timedelta(days=1))
    merged = {r["store_id"]: r for r in inc.merge_incidents(existing, run, later).collect()}
    assert {k: r["change"] for k, r in merged.items()} == {"A": "unchanged", "B": "updated", "C": "created"}
    assert merged["A"]["severity_score"] == 1.0 and merged["B"]["severity_score"] > 1.0
    assert merged["B"]["headline"] == "kept" and merged["B"]["updated_at"] > merged["B"]["created_at"]
    assert inc.run_counts(run, existing).first().asDict() == {"incidents_created": 1, "incidents_updated": 1}
    run.unpersist()


def test_whole_run_is_repeatable(spark):
    raw = spark.createDataFrame(daily_rows(11), RAW)
    first = run_detection(raw, F.lit(NOW))
    again = run_detection(raw.repartition(9), F.lit(NOW))
    for name in ("features", "detections", "incidents", "items", "notes", "stats"):
        a, b = (sorted(map(repr, getattr(r, name).collect())) for r in (first, again))
        assert a == b, name
    stats = first.stats.first()
    assert stats["features_created"] == len(daily_rows(11)) and stats["detection_mode"] == "full"
    assert stats["incidents_created"] == first.incidents.count() == first.notes.count() > 0
    assert stats["isolation_forest_flags"] > 0
    shares = first.items.groupBy("incident_id").agg(F.sum("contribution_score").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) or r["s"] == 0 for r in shares)
    ids = first.items.select(F.explode("detection_result_ids").alias("detection_id"))
    assert ids.join(first.detections, "detection_id", "left_anti").isEmpty()
    # A rerun over its own incidents creates nothing.
    third = run_detection(raw, F.lit(NOW + dt.timedelta(days=1)), existing=first.incidents, with_forest=True)
    assert third.stats.first()["incidents_created"] == 0 and third.incidents.count() == first.incidents.count()


def test_duplicate_rows_are_refused(spark):
    rows = daily_rows(12)
    with pytest.raises(DuplicateRows):
        run_detection(spark.createDataFrame([*rows, rows[0]], RAW), F.lit(NOW))


def table(spark):
    rows = [
        (f"i{i}", TUE, store, status, float(sev), 2, 10.25)
        for i, (store, status, sev) in enumerate([("S1", "open", 80), ("S2", "open", 50), ("S3", "investigating", 75), ("S4", "resolved", 90)])
    ]
    df = spark.createDataFrame(rows, "incident_id string, date date, store_id string, status string, severity_score double, sku_count bigint, estimated_impact double")
    return df.withColumns(
        {
            "assignee": F.lit(None).cast("string"),
            "resolution_reason": F.lit(None).cast("string"),
            "resolved_at": F.lit(None).cast("timestamp"),
            "updated_at": F.lit(NOW),
            "headline": F.lit("h"),
        }
    )


def test_summary_and_lists(spark):
    t = table(spark)
    s = rep.incident_summary(t).first()
    assert (s["high_severity_count"], s["affected_stores"], s["affected_skus"], s["total_estimated_impact"], s["active_incidents"]) == (2, 3, 6, 30.75, 3)
    assert rep.incident_summary(t.filter("status = 'resolved'")).first()["high_severity_count"] == 0
    assert {r["status"]: r["incidents"] for r in rep.status_counts(t).collect()} == {"open": 2, "investigating": 1, "resolved": 1}
    assert {r["bucket"]: r["incidents"] for r in rep.severity_distribution(t).collect()} == {"Low": 0, "Medium": 1, "High": 1, "Critical": 2}
    assert [r["incident_id"] for r in rep.incident_page(t, page_size=2).collect()] == ["i3", "i0"]
    assert [r["incident_id"] for r in rep.incident_page(t, page=2, page_size=2).collect()] == ["i2", "i1"]
    assert [r["incident_id"] for r in rep.incident_page(t, status="OPEN", min_severity=60).collect()] == ["i0"]
    assert rep.page_totals(t, 3).first().asDict() == {"total": 4, "pages": 2}
    assert [r["store_id"] for r in rep.top_stores(t, 2).collect()] == ["S1", "S2"]
    with pytest.raises(ValueError, match="Invalid status"):
        rep.incident_page(t, status="closed")


def test_changes_and_audit(spark):
    at = [NOW + dt.timedelta(minutes=40 * i) for i in range(6)]
    log = spark.createDataFrame(
        [
            ("i0", 1, at[0], "Investigating", "ann", None),
            ("i0", 2, at[1], "investigating", "ann", None),
            ("i0", 3, at[2], "resolved", None, "fixed"),
            ("i0", 4, at[3], None, "", None),
            ("i3", 5, at[4], "open", None, None),
            ("missing", 6, at[5], "open", "bob", None),
        ],
        "incident_id string, change_id int, changed_at timestamp, status string, assignee string, resolution_reason string",
    )
    t = table(spark).withColumn("resolved_at", F.when(F.col("status") == "resolved", F.lit(NOW)))
    done = {r["incident_id"]: r for r in work.apply_changes(t, log).collect()}
    assert (done["i0"]["status"], done["i0"]["assignee"], done["i0"]["resolution_reason"], done["i0"]["resolved_at"]) == ("resolved", None, "fixed", at[2])
    assert (done["i3"]["status"], done["i3"]["resolved_at"]) == ("open", None)
    assert done["i1"]["updated_at"] == NOW and len(done) == 4
    notes = sorted((r["change_id"], r["content"], r["note_type"]) for r in work.audit_notes(t, log).collect())
    assert notes == [
        (1, "Assignment changed from unassigned to ann", "assignment"),
        (1, "Status changed from open to investigating", "status_change"),
        (3, "Resolution reason updated", "assignment"),
        (3, "Status changed from investigating to resolved", "status_change"),
        (4, "Assignment changed from ann to unassigned", "assignment"),
        (5, "Status changed from resolved to open", "status_change"),
    ]
    assert work.invalid_changes(log.withColumn("status", F.lit("closed"))).count() == 6
    assert work.invalid_changes(log).isEmpty()
    said = spark.createDataFrame([("i1", "hello", None, NOW), ("missing", "x", "u", NOW)], "incident_id string, content string, author string, created_at timestamp")
    assert [(r["author"], r["content"], r["note_type"]) for r in work.comment_notes(t, said).collect()] == [("user", "hello", "comment")]


def test_one_incident_with_most_changes(spark):
    """The hour-wise carry gives the same history as walking through it."""
    log = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "i1").otherwise("i0").alias("incident_id"),
        F.col("id").cast("int").alias("change_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 17).alias("changed_at"),
        F.element_at(F.array(F.lit("open"), F.lit("resolved"), F.lit(None), F.lit("investigating")), (F.xxhash64("id") % 2 + F.col("id") % 3).cast("int") % 4 + 1 + F.when(F.xxhash64("id") % 2 < 0, 1).otherwise(0)).alias("status"),
        F.lit(None).cast("string").alias("assignee"),
        F.lit(None).cast("string").alias("resolution_reason"),
    )
    walked, state = [], {"i0": "open", "i1": "open"}
    for r in sorted(log.collect(), key=lambda r: r["change_id"]):
        if r["status"] and r["status"] != state[r["incident_id"]]:
            walked.append((r["change_id"], f"Status changed from {state[r['incident_id']]} to {r['status']}"))
            state[r["incident_id"]] = r["status"]
    got = sorted((r["change_id"], r["content"]) for r in work.audit_notes(table(spark), log).collect())
    assert len(got) > 500 and got == walked
