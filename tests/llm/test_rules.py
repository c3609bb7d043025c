import re

from helpers import awkward, frame

from fenceline.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for w in words for c in w),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_match_brute_force(spark):
    rows = awkward()
    out = rules.quality_rules(frame(spark, rows), labels_of(spark, [(0, 1, 0)])).collect()
    got = sorted((repr(r["doc_id"]), *tuple(r)[1:7]) for r in out)
    assert got == sorted((repr(i), *brute(t)) for i, t in rows)


def test_rules_are_learned_and_applied(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(f"word{i}x{k}###" for k in range(30))) for i in range(60)]
    labels = labels_of(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad])
    docs = frame(spark, [*good, *bad, (500, "plain words " + " ".join(f"y{k}" for k in range(20)))])
    kept = {r["doc_id"] for r in rules.quality_rules(docs, labels).where("kept").collect()}
    assert kept == {i for i, _ in good} | {500}
    assert rules.keep_good(docs, labels).columns == docs.columns


def test_no_labels_and_no_rows(spark):
    empty = frame(spark, []).limit(0)
    assert rules.quality_rules(empty, labels_of(spark, [])).count() == 0
    one = rules.quality_rules(frame(spark, [(1, "a b c d e f g h i j k")]), labels_of(spark, [])).first()
    assert one["kept"]
