import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from fenceline.functions.parsing import date_from_text, parse_date, parse_number, parse_typed_date
from fenceline.operators import ingest, profile as prof
from fenceline.operators.ingest import DatasetSchema

DAY = dt.date(2024, 1, 15)


def test_dates(spark):
    # Forms of one date that must be understood.
    cases = {
        "15-Jan-2024": DAY, "15/01/24": DAY, "Mon, 15 Jan 2024": DAY, "15th January 2024": DAY, "Jan-15-2024": DAY,
        "20240115": DAY, "15-Jan-99": dt.date(1999, 1, 15), "20241315": dt.date(1970, 8, 23),
        "2024-01-15": DAY, "15/01/2024": DAY, "January 15, 2024": DAY, "1705276800": DAY, "15 Jan 2024": DAY,
        "15.01.2024": DAY, "2024/1/15": DAY, "2024-01-15 10:30:00": DAY, "2024-01-15T10:30:00": DAY, "01/15/2024": DAY,
        "15/01/2024 08:00": DAY, "45306": DAY, "": None, "  ": None, "not a date": None, "2024-13-40": None,
        "2024-01-02": dt.date(2024, 1, 2), "03/02/2024": dt.date(2024, 2, 3), "99999999999999999999": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", parse_date(F.col("v")).alias("d"))
    assert {r["v"]: r["d"] for r in df.collect()} == cases
    numbers = spark.createDataFrame([(1705276800.0,), (45306.9,), (None,)], "v double")
    assert [r[0] for r in numbers.select(parse_typed_date(F.col("v"), "double")).collect()] == [DAY, DAY, None]


def test_numbers(spark):
    cases = {
        "42": 42.0, "42.5": 42.5, "$42.50": 42.5, "£42.50": 42.5, "€42.50": 42.5, "1,000.50": 1000.5, "-3e2": -300.0,
        "": None, "not a number": None, "5d": None, "NaN": None, ".5": 0.5,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", parse_number(F.col("v")).alias("n"))
    assert {r["v"]: r["n"] for r in df.collect()} == cases


SCHEMA = DatasetSchema(7, "t", "date", ["store", "product"], ["sales", "stock"], ["promo"])


def rows(spark):
    return spark.createDataFrame(
        [
            (0, "2024-01-15", " S1 ", "P1", "100", "50", "yes"),
            (1, "invalid", "S2", None, "$1,200", None, None),
            (2, "2024-01-16", None, None, None, "x", "no"),
            (3, None, None, None, "5", None, "no"),
        ],
        "row_index bigint, date string, store string, product string, sales string, stock string, promo string",
    )


def test_clean_errors_and_summary(spark):
    cleaned = ingest.clean(rows(spark), SCHEMA)
    valid = {r["row_index"]: r for r in ingest.valid_rows(cleaned).collect()}
    assert set(valid) == {0, 1}
    assert (valid[0]["store"], valid[0]["date"], valid[1]["date"], valid[1]["sales"]) == ("S1", DAY, None, 1200.0)
    errors = [(r["row"], r["error"]) for r in ingest.row_errors(cleaned).collect()]
    assert errors == [(4, ingest.NO_IDENTIFIER), (4, ingest.NO_METRIC), (5, ingest.NO_IDENTIFIER)]
    assert ingest.transform_summary(cleaned).first().asDict() == {"total_rows": 4, "valid_rows": 2, "error_rows": 2}


def test_identifier_key_and_packing(spark):
    packed = {r["row_id"]: r for r in ingest.packed_rows(ingest.valid_rows(ingest.clean(rows(spark), SCHEMA)), SCHEMA).collect()}
    assert packed[0]["identifier_key"] == hashlib.sha256(b"product=P1|store=S1").hexdigest()[:32]
    assert packed[1]["identifier_key"] == hashlib.sha256(b"store=S2").hexdigest()[:32]
    assert packed[1]["identifiers"] == {"store": "S2"} and packed[1]["metrics"] == {"sales": 1200.0}
    assert packed[1]["attributes"] == {} and packed[0]["dataset_id"] == 7


def test_no_identifiers_declared(spark):
    schema = DatasetSchema(1, metrics=["sales"])
    cleaned = ingest.clean(rows(spark), schema)
    assert ingest.valid_rows(cleaned).count() == 3
    assert [r["identifier_key"] for r in cleaned.collect()] == [None] * 4


def test_missing_columns_are_listed(spark):
    with pytest.raises(ingest.MissingColumns) as e:
        ingest.clean(rows(spark), DatasetSchema(1, date_column="when", metrics=["sales", "profit"]))
    assert e.value.missing == ["when", "profit"] and "stock" in e.value.available


def test_row_index_follows_the_file(spark):
    df = ingest.with_row_index(spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v"))
    assert all(r["v"] == r["row_index"] for r in df.collect())
    # A sort cuts its ranges anew in each run.
    mixed = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v, 1")).orderBy("`v, 1`")
    assert all(r["v, 1"] == r["row_index"] for r in ingest.with_row_index(mixed).collect())
    assert ingest.with_row_index(spark.range(0)).count() == 0


def types_of(spark, columns):
    n = max(len(v) for v in columns.values())
    data = [(i, *[v[i] if i < len(v) else None for v in columns.values()]) for i in range(n)]
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    ddl = "pos int, " + ", ".join(f"`{k}` {kinds[type(v[0])] if v else 'string'}" for k, v in columns.items())
    return prof.profile(spark.createDataFrame(data, ddl), "pos")


def test_detected_types(spark):
    got = types_of(
        spark,
        {
            "rooms": [7, 9, 2],
            "rent": [0.25, 81.0],
            "seats": ["12", "3,400", "8"],
            "fare": ["€7.20", "9", "11.05"],
            "day_seen": ["2031-05-02", "2031-05-09"],
            "moment": [f"2031-06-{d:02d}" for d in range(3, 28)],
            "open": ["y", "n", "n"],
            "lit": ["on", "off", "on", "on"],
            "colour": list("rgbrgrrbgr"),
            "remark": [f"seen near gate {i}" for i in range(120)],
            "blank": [],
            "sealed": [False, True],
            "late": ["5"] * 110 + ["five", "six"],
        },
    )
    kinds = {r["column_name"]: r["detected_type"] for r in got.collect()}
    assert kinds == {
        "rooms": "integer", "rent": "float", "seats": "integer", "fare": "float", "day_seen": "date", "moment": "date",
        "open": "boolean", "lit": "boolean", "colour": "categorical", "remark": "text", "blank": "unknown",
        "sealed": "boolean", "late": "categorical",
    }


def test_profile_numbers_roles_and_suggestion(spark):
    got = types_of(
        spark,
        {
            "booked_day": ["2031-05-02", "2031-05-03", "2031-05-09"],
            "branch": ["north", "south", "north"],
            "vendor_code": ["q7", "q8", "q9"],
            "volume": [4, 8, 12],
            "profit": [3.5, 9.25, None],
            "sealed": [True, False, True],
        },
    ).cache()
    by = {r["column_name"]: r for r in got.collect()}
    assert (by["volume"]["mean_value"], by["volume"]["std_value"]) == (8.0, 4.0)
    assert (by["profit"]["null_count"], by["profit"]["total_count"], by["profit"]["unique_count"]) == (1, 3, 2)
    assert by["branch"]["sample_values"] == ["north", "south"] and by["branch"]["mean_value"] is None
    assert (by["sealed"]["suggested_role"], by["sealed"]["role_confidence"]) == ("attribute", 0.7)
    s = prof.suggest_schema(got).first()
    assert (s["date_column"], s["identifiers"], s["metrics"], s["warnings"]) == (
        "booked_day", ["branch", "vendor_code"], ["volume", "profit"], [],
    )
    warned = prof.suggest_schema(types_of(spark, {"text": [f"words {i}" for i in range(30)]})).first()
    assert len(warned["warnings"]) == 3 and warned["date_column"] is None


def test_all_errors_are_kept(spark):
    bad = spark.range(200).select(F.col("id").alias("row_index"), *[F.lit(None).cast("string").alias(c) for c in ("date", "store", "product", "sales", "stock", "promo")])
    assert ingest.row_errors(ingest.clean(bad, SCHEMA)).count() == 400


def test_csv_cells(spark, tmp_path):
    from fenceline.plans.flexible import analyze_csv
    from fenceline.sources.csv import read_csv

    lines = ["shop,qty,yes,note"] + [f"s{i % 4},{'NA' if i % 7 == 0 else i},{i % 2},{'n/a' if i % 2 else 'fine'}" for i in range(60)]
    path = str(tmp_path / "cells.csv")
    (tmp_path / "cells.csv").write_text("\n".join(lines))
    found = analyze_csv(spark, path)
    by = {r["column_name"]: r for r in found.profile.collect()}
    assert (by["qty"]["detected_type"], by["qty"]["null_count"], by["qty"]["suggested_role"]) == ("integer", 9, "metric")
    assert by["yes"]["detected_type"] == "integer" and by["note"]["null_count"] == 30
    assert [r["shop"] for r in found.preview.collect()][:5] == ["s0", "s1", "s2", "s3", "s0"]
    broken = tmp_path / "broken.csv"
    broken.write_text('shop,qty,note\na,1,"two\nlines"\nb,2,plain\n')
    assert [r["note"] for r in read_csv(spark, str(broken)).collect()] == ["two\nlines", "plain"]
    with pytest.raises(ValueError):
        read_csv(spark, str(broken), multi_line=False)


def test_two_uploads_have_distinct_row_ids(spark, tmp_path):
    from fenceline.plans.flexible import upload
    from fenceline.sources import datasets

    (tmp_path / "a.csv").write_text("store,sales\n" + "\n".join(f"s{i},{i}" for i in range(20)))
    schema = {c: None for c in ("dataset_id",)}
    registry = spark.createDataFrame([], datasets.REGISTRY)
    row = {f.name: None for f in registry.schema} | schema | {"dataset_id": 7, "name": "t", "identifier_columns": ["store"], "metric_columns": ["sales"], "attribute_columns": [], "row_count": 0}
    registry = spark.createDataFrame([tuple(row[f.name] for f in registry.schema)], registry.schema)
    rows_path = str(tmp_path / "rows")
    for _ in range(2):
        registry = upload(spark, registry, 7, str(tmp_path / "a.csv"), rows_path).registry
    stored = spark.read.parquet(rows_path)
    assert stored.count() == stored.select("row_id").distinct().count() == 40


def test_approximate_profile_is_close(spark):
    long = prof.cells(spark.range(5000).withColumn("v", F.col("id") % 700), "id")
    exact, rough = prof.column_counts(long).first(), prof.column_counts(long, approximate=True).first()
    assert exact["unique_count"] == 700 and abs(rough["unique_count"] - 700) < 70


def test_profile_reads_its_source_once_per_pass(spark, tmp_path):
    path = str(tmp_path / "profiled")
    spark.range(400).selectExpr("id", "id % 7 as v", "cast(id % 3 as string) as t").write.parquet(path)
    source = spark.read.parquet(path)

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")

    assert scans(prof.detect_types(prof.column_counts(prof.cells(source, "id")))) == 1
    numbers = prof.numeric_stats(source, "id")
    assert scans(numbers) == 1 and "Generate explode" not in numbers._jdf.queryExecution().optimizedPlan().toString()


def test_numeric_stats_of_awkward_columns(spark):
    from decimal import Decimal

    rows = [
        (float("nan"), 0.1, Decimal("1.25"), " 4 ", True, None),
        (float("inf"), 0.5, Decimal("2.75"), "x", False, None),
        (2.0, None, None, "1e1", None, None),
    ]
    df = spark.createDataFrame(rows, "a double, `b.c` float, d decimal(9,2), e string, f boolean, g int")
    got = {r["ordinal"]: tuple(r)[1:] for r in prof.numeric_stats(df).collect()}
    deviation = 2**0.5
    assert got[0] == (2.0, 2.0, 2.0, 0.0)
    assert got[1] == (0.1, 0.5, 0.3, pytest.approx(0.4 / deviation))
    assert got[2] == (1.25, 2.75, 2.0, pytest.approx(1.5 / deviation))
    assert got[3] == (4.0, 10.0, 7.0, pytest.approx(6 / deviation))
    assert got[4] == got[5] == (None,) * 4
    assert {tuple(r)[1:] for r in prof.numeric_stats(df.limit(0)).collect()} == {(None,) * 4}


def test_dates_by_shape(spark):
    texts = ["3/4/2021", "03-04-2021", "4.13.2021", "3/4-2021", "n/a", "5", "3/4/21", "1st May 2021", "Mon, 3/4/2021 10:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(date_from_text(F.col("t")).cast("string"))
    april = "2021-04-03"
    assert [r[0] for r in df.collect()] == [april, april, "2021-04-13", None, None, None, april, "2021-05-01", april]


def test_dates_are_not_lost_by_their_shape(spark, monkeypatch):
    """The tests of the shape keep every text that a formatter reads, and others never come to one."""
    from fenceline.functions import parsing

    days, months = ["5", "05", "31", "1st"], ["5", "05", "May", "may", "Sep", "Sept", "SEPTEMBER", "December", "\u017fep", "mayor"]
    years = ["2020", "20", "99", "12345"]
    texts = [x for d in days for m in months for y in years for x in (
        f"{d} {m} {y}", f"{d}-{m}-{y}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{m} {d}, {y}", f"{m} {d} {y}", f"{m}-{d}-{y}",
        f"{y}/{m}/{d}", f"{y}.{m}.{d}", f"{y}-{m}-{d}", f"Mon, {d} {m} {y}", f" {d} {m} {y} 10:30 pm", f"{d}/{m}/{y}T10:00:00Z",
    )]
    texts += ["plain 123456", "two\nlines 25", "order 12 of 2020", "12 34 56", "1234 56 78", "a-b-12", "5 May", "20200505"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def read():
        return [str(r[0]) for r in df.select(parsing.date_from_text(F.col("t"))).collect()]

    guarded, plan = read(), df.select(parsing.date_from_text(F.col("t")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert parsing.SEPARATED in plan and parsing.FOREIGN_WORD[:20] in plan and plan.count("st|nd|rd|th") == 1
    monkeypatch.setattr(parsing, "SEPARATED", "")
    monkeypatch.setattr(parsing, "FOREIGN_WORD", "(?!)")
    assert guarded == read()
    assert 300 < sum(d != "None" for d in guarded) < len(texts)
