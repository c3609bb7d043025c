import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.operators import flexible as flex
from fenceline.operators.ingest import DatasetSchema, identifier_key
from fenceline.plans import flexible as plan
from fenceline.sources import datasets
from fenceline.sources.csv import csv_encoding, read_csv

NOW = dt.datetime(2024, 6, 1)
SCHEMA = DatasetSchema(3, "sensors", "date", ["site", "unit"], ["temp", "load", "few"], [])


def sensor_rows(spark, n=400):
    """One site holds most rows and most flags; some rows lack identifiers or dates."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        site = None if i % 50 == 7 else "hot" if i % 3 else f"s{i % 5}"
        date = None if i % 40 == 3 else dt.date(2024, 1, 1) + dt.timedelta(i % 60)
        temp = 500.0 + i if i % 25 == 1 else float(rng.normal(20, 2))
        load = float("nan") if i % 30 == 2 else float(rng.normal(5, 1))
        rows.append((i, date, site, None if site is None else "u1", temp, load, 1.0 if i < 5 else None))
    df = spark.createDataFrame(rows, "row_id bigint, date date, site string, unit string, temp double, load double, few double")
    return rows, df.withColumn("identifier_key", identifier_key(SCHEMA))


def test_whole_table_fences(spark):
    rows, df = sensor_rows(spark)
    out = flex.flexible_tukey(df, SCHEMA).collect()
    assert {r["metric_name"] for r in out} == {"temp", "load"}  # too few values in the third
    temps = [r[4] for r in rows]
    q1, q3 = np.percentile(temps, 25), np.percentile(temps, 75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    want = {r[0] for r in rows if r[4] < low or r[4] > high}
    assert {r["row_id"] for r in out if r["metric_name"] == "temp" and r["is_outlier"]} == want and len(want) >= 16
    one = next(r for r in out if r["row_id"] == 1 and r["metric_name"] == "temp")
    assert one["reason"] == f"temp value 501.00 is above normal range [{low:.2f}, {high:.2f}]"
    assert sum(r["metric_name"] == "load" for r in out) == sum(r[5] == r[5] for r in rows)


def test_forest_needs_two_metrics_and_twenty_rows(spark):
    _, df = sensor_rows(spark)
    assert flex.flexible_forest(df, DatasetSchema(1, metrics=["temp"])) is None
    assert flex.flexible_forest(df, SCHEMA) is None  # five complete rows
    two = DatasetSchema(3, "sensors", "date", ["site", "unit"], ["temp", "load"], [])
    out = flex.flexible_forest(df, two).collect()
    complete = df.filter("not isnan(load)").count()
    assert len(out) == complete and abs(sum(r["is_outlier"] for r in out) - 0.05 * complete) <= 1
    assert all(r["reasons"] == [] for r in out if not r["is_outlier"])
    told = [m for r in out for m in r["reasons"]]
    assert told and all(m["z_score"] > 2 and m["message"].endswith("standard deviations from mean") for m in told)


def test_run_makes_one_incident_per_identifier(spark):
    _, df = sensor_rows(spark)
    schema = DatasetSchema(3, "sensors", "date", ["site", "unit"], ["temp", "load"], [])
    run = plan.run_flexible_detection(df, schema, NOW)
    found = run.detections.filter("is_outlier and identifier_key is not null").collect()
    incidents = {r["incident_id"]: r for r in run.incidents.collect()}
    by_key = {}
    for r in found:
        by_key.setdefault(r["identifier_key"], []).append(r)
    assert len(incidents) == len(by_key) and run.notes.count() == len(by_key)
    for key, rs in by_key.items():
        date = min((r["date"] for r in rs if r["date"]), default=NOW.date())
        row = incidents[hashlib.sha256(f"3_{key}_{date.isoformat()}".encode()).hexdigest()[:32]]
        kinds = {r["detector_type"] for r in rs}
        assert row["severity_score"] == min(20 + 5 * len(rs) + 15 * len(kinds), 100)
        assert row["detectors_triggered"] == [k for k in ("tukey", "isolation_forest") if k in kinds]
        assert row["headline"].endswith(f" for {rs[0]['label']}") and len(row["description"].split("\n")) <= 10
    again = plan.run_flexible_detection(df, schema, NOW, existing=run.incidents)
    stats = again.stats.first()
    assert stats["rows_analyzed"] == 400 and stats["incidents_created"] == 0 and stats["incidents_updated"] == len(by_key)
    assert again.notes.isEmpty()


def test_guards(spark):
    _, df = sensor_rows(spark)
    with pytest.raises(flex.NoMetrics):
        plan.run_flexible_detection(df, DatasetSchema(1), NOW)
    with pytest.raises(flex.NoRows):
        plan.run_flexible_detection(df.limit(0), SCHEMA, NOW)
    with pytest.raises(datasets.UnknownDataset):
        datasets.get_schema(datasets.empty_registry(spark), 5)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_encodings(spark, tmp_path):
    text = 'name,n\n"Café, ""Été""",1\nplain,2\n'
    utf8, latin = write(tmp_path / "u.csv", text), write(tmp_path / "l.csv", text, "latin-1")
    assert (csv_encoding(spark, utf8), csv_encoding(spark, latin)) == ("UTF-8", "ISO-8859-1")
    for path in (utf8, latin):
        df = read_csv(spark, path)
        assert [tuple(r) for r in df.orderBy("n").collect()] == [('Café, "Été"', 1), ("plain", 2)]
    assert dict(read_csv(spark, utf8, infer_types=False).dtypes)["n"] == "string"


def test_upload_from_csv_to_incidents(spark, tmp_path):
    lines = ["when,shop,item,units,total"]
    for i in range(60):
        lines.append(f"{1 + i % 28:02d}/03/2024,shop{i % 3},item{i % 4},{500 if i == 30 else 10 + i % 5},\"$1,{100 + i % 7}.50\"")
    lines += ["bad date,,,3,4", "2024-03-05,shop1,item1,n/a,"]
    csv = write(tmp_path / "sales.csv", "\n".join(lines) + "\n")

    analysis = plan.analyze_csv(spark, csv)
    kinds = {r["column_name"]: (r["detected_type"], r["suggested_role"]) for r in analysis.profile.collect()}
    assert kinds["when"] == ("date", "date") and kinds["shop"][1] == "identifier" and kinds["total"] == ("float", "metric")
    assert analysis.preview.count() == 20 and analysis.suggestion.first()["date_column"] == "when"

    registry = datasets.create_dataset(datasets.empty_registry(spark), 9, NOW, name="empty")
    wanted = '{"name": "Sales", "date_column": "when", "identifier_columns": ["shop", "item"], "metric_columns": ["units", "total"]}'
    stored = str(tmp_path / "rows")
    up = plan.upload_with_schema(spark, registry, 9, wanted, csv, stored, NOW)
    entry = datasets.list_datasets(up.registry).first()
    assert (entry["name"], entry["row_count"], entry["date_range_start"], entry["date_range_end"]) == ("Sales", 60, dt.date(2024, 3, 1), dt.date(2024, 3, 28))
    assert '"name":"when","detected_type":"date"' in entry["column_analysis"]
    assert up.summary.first().asDict() == {"total_rows": 62, "valid_rows": 60, "error_rows": 2}
    assert [(r["row"], r["error"]) for r in up.errors.collect()] == [(62, "All identifier columns are empty"), (63, "All metric columns are empty")]

    rows = plan.unpack_rows(spark.read.parquet(stored), datasets.get_schema(up.registry, 9))
    run = plan.run_flexible_detection(rows, datasets.get_schema(up.registry, 9), NOW)
    assert run.detections.filter("is_outlier and metric_name = 'units' and actual_value = 500").count() == 1

    left, kept = datasets.delete_dataset(9, up.registry, spark.read.parquet(stored))
    assert left.isEmpty() and kept.isEmpty()


def test_rewriting_dates_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(20).select("id", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 4).cast("int")).alias("date"))
    for part in (df, df.filter("date > '2024-01-02'"), df):
        datasets.overwrite_dates(part, path)
        assert spark.read.parquet(path).count() == 20


def test_children_go_with_their_incident(spark):
    notes = spark.createDataFrame([("a", "x"), ("b", "y")], "incident_id string, content string")
    gone = spark.createDataFrame([("a",)], "incident_id string")
    assert [r["content"] for r in datasets.delete_children(notes, gone).collect()] == ["y"]
