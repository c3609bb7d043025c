import csv
import random

import pytest

from fenceline.sources.csv import read_csv, records


def written(tmp_path, files, newline="\n"):
    folder = tmp_path / "cells"
    folder.mkdir()
    for i, rows in enumerate(files):
        with (folder / f"{i}.csv").open("w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerows([["key", "note", "last,one"], *rows])
    return str(folder)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_tasks(spark, tmp_path, small_splits, newline):
    random.seed(5)
    bits = ["a", ",", '"', "\n", '""', ",\"", "\n\n", "é", " b"]
    files = []
    for f in range(3):
        rows = [[str(f * 1000 + i), "x" + "".join(random.choices(bits, k=random.randrange(9))), f"z{i}"] for i in range(150)]
        rows[70][1] = "long\n" * 700  # over several splits
        files.append(rows)
    got = read_csv(spark, written(tmp_path, files, newline), infer_types=False)
    assert got.columns == ["key", "note", "last,one"]
    want = [tuple(r) for rows in files for r in rows]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    order = [int(r["key"]) for r in got.collect()]
    assert all(order[i] < order[i + 1] for i in range(len(order) - 1) if order[i] // 1000 == order[i + 1] // 1000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Python" not in plan
    assert spark.read.text(str(tmp_path / "cells"), lineSep="\n").rdd.getNumPartitions() > 5


def test_stray_quotes_do_not_swallow_rows(spark, tmp_path, small_splits):
    path = tmp_path / "stray.csv"
    body = "".join(f'{i},{i}" pipe,"in quotes, {i}"\n' for i in range(200))
    path.write_text("n,size,note\n" + body + '900,"two\nlines",x\n')
    got = {r["n"]: (r["size"], r["note"]) for r in read_csv(spark, str(path), infer_types=False).collect()}
    assert len(got) == 201 and got["7"] == ('7" pipe', "in quotes, 7") and got["900"] == ("two\nlines", "x")


def test_records_of_any_splits_equal_one_split(spark):
    random.seed(8)
    lines = ["".join(random.choices(["a", ",", '"', '""'], k=random.randrange(6))) for _ in range(120)]

    def of(cut):
        rows = [("f", sum(i >= c for c in cut), i, line) for i, line in enumerate(lines)]
        df = spark.createDataFrame(rows, "file string, block long, id long, line string")
        return [(r["id"], r["text"]) for r in records(df).orderBy("id").collect()]

    def walk():
        """Character by character: a quote opens at the beginning of a cell and closes when it stands alone."""
        out, inside = [], False
        for i, line in enumerate(lines):
            if inside:
                out[-1] = (out[-1][0], out[-1][1] + "\n" + line)
            else:
                out.append((i, line))
            k, fresh = 0, not inside
            while k < len(line):
                if line[k] == '"':
                    if inside and line[k + 1 : k + 2] == '"':
                        k += 1
                    elif inside:
                        inside = False
                    elif fresh:
                        inside = True
                    fresh = False
                elif not inside:
                    fresh = line[k] == ","
                k += 1
        return out

    assert of([]) == walk()
    assert of([3, 4, 50, 51, 90]) == walk()
    assert records(spark.createDataFrame([], "file string, block long, id long, line string")).count() == 0


def test_a_line_is_searched_for_quotes_once(spark):
    """Each of the two passes over the lines (state of splits, records) marks opening quotes once a line."""
    lines = spark.createDataFrame([("f", 0, 0, 'a,"b'), ("f", 0, 1, 'c",d')], "file string, block long, id long, line string")
    found = records(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count('(^|,)"') <= 2
    assert [r["text"] for r in found.collect()] == ['a,"b\nc",d']
