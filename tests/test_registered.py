"""Every registered query against its SQL on the smallest tables."""

import math

import pytest
import side_by_side

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return side_by_side.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    problem, rows, _ = side_by_side.compare(spark, con, name, SF)
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_sql(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows
    if "anomaly_score" in rows[0]:
        assert all(-1 <= r["anomaly_score"] <= 1 and not math.isnan(r["anomaly_score"]) for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "is_outlier" in df.columns and not df.isEmpty()
