"""Run registered queries on Spark and DuckDB over the same tables and compare every row.

    python tests/side_by_side.py [sf_dir] [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name, sf_dir):
    """(problem or None, row count, Spark seconds)."""
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(rows), seconds
    kinds = {name: kind for name, kind, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    columns = list(kinds)
    expected = con.execute(sql).fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(rows), seconds
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [(c, k, kinds[c]) for c, k in df.dtypes if names.get(k) != kinds[c]]
    got, want = canonical(df.columns, rows), canonical(columns, expected)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(rows), seconds
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    if differing:
        only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{len(only_got)} rows differ, e.g.\n  {only_got[:2]}\n  {only_want[:2]}", len(rows), seconds
    if wrong:
        return f"types {wrong}", len(rows), seconds
    return None, len(rows), seconds


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), duck(folder)
    picked = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in picked:
        try:
            problem, n, seconds = compare(spark, con, name, folder)
        except Exception as e:  # keep going: this is a report
            problem, n, seconds = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0.0
        bad += problem is not None
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} rows={n:<8d} {seconds:6.2f}s{kind}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print(f"{len(picked) - bad} of {len(picked)} match")
