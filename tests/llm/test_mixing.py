import duckdb
from helpers import awkward, frame

from fenceline.llm import mixing


def mixed(spark, rows):
    return sorted((repr(r["doc_id"]), *tuple(r)[1:]) for r in mixing.mix(frame(spark, rows)).collect())


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[2]) for r in rows])
    return sorted((repr(r[0]), *r[1:]) for r in con.execute(mixing.SQL).fetchall())


def test_matches_sorting_with_nulls_ties_and_a_hot_source(spark):
    rows = [(i, t, ("hot", "b", None, "c", "Z")[0 if k % 3 else k % 5]) for k, (i, t) in enumerate(awkward()) if "\x00" not in (t or "")]
    got = mixed(spark, rows)
    assert got == by_sql(rows)
    taken, size = {}, {}
    for r in got:
        assert 0 <= r[4] <= 2 * r[1]
        taken[r[2], r[3]] = taken.get((r[2], r[3]), 0) + r[4]
    for (_, target), n in taken.items():
        assert abs(n - target) <= 1
    assert got == mixed(spark, rows[::-1])


def test_empty_table_and_empty_texts(spark):
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()} == {0}


def test_repeated_rows_keep_columns(spark):
    docs = frame(spark, [(i, "a b c d", "x" if i % 2 else "y") for i in range(40)] + [(99, None, "x")])
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert 50 <= out.where("text IS NOT NULL").count() <= 70 and out.where("text IS NULL").count() == 1


def test_rows_without_an_id_or_with_one_id_meet_the_target_of_each_source(spark):
    # With weights 3, 1, 2 source a is doubled, b keeps 3/4 of its rows and c one and a half times as many.
    def kept(ids):
        rows = [(ids(i), f"t{i} b c d", "abc"[i % 3]) for i in range(600)]
        want = {r["source"]: r["target"] for r in mixing.source_targets(
            spark.createDataFrame([(s, 4) for _, _, s in rows], "source string, size long")).collect()}
        got = {r["source"]: 4 * r["count"] for r in mixing.repeated(frame(spark, rows)).groupBy("source").count().collect()}
        assert all(abs(got[s] - want[s]) <= 4 for s in "abc"), (got, want)

    kept(lambda i: None)
    kept(lambda i: 7)
    kept(lambda i: i)


def test_repeated_takes_unique_ids_as_the_mix_does(spark):
    docs = frame(spark, [(i, "a b c d " * (i % 5 + 1), "xyz"[i % 3]) for i in range(100)])
    want = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(docs).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.repeated(docs).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
