import random

import numpy as np
from helpers import awkward, frame

from fenceline.llm import graph, jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((repr(i), len(s), repr(least.get(root(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_groups_match_brute_force(spark):
    rng = random.Random(6)
    rows = awkward()
    for family in range(8):  # chains of near copies, a large group among them
        base = [f"w{family}x{rng.randint(0, 40)}" for _ in range(rng.choice([12, 60, 120]))]
        for k in range(60 if family == 0 else 8):
            base = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                base[rng.randrange(len(base))] = f"n{rng.randint(0, 10**6)}"
            rows.append((1000 + 100 * family + k, " ".join(base)))
    rng.shuffle(rows)
    out = jaccard.groups(frame(spark, rows)).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in out) == brute(rows)


def test_one_of_each(spark):
    docs = frame(spark, [(3, "a b c d e f g"), (1, "A B c d e f g"), (1, "a b c d e f g"), (2, None), (None, "a b c d e f g")])
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == ["1", "2"]
    assert jaccard.groups(frame(spark, []).limit(0)).count() == 0


def test_many_texts_that_share_most_words_but_do_not_link(spark, monkeypatch):
    """Their shared n-grams lead, but hardly any pair is compared; links among them are still found."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    # About 70 % of each set is the passage; two texts share 0.54 of their sets.
    rows = [(k, " ".join(passage + [f"u{k}x{j}" for j in range(22)])) for k in range(300)]
    for k in range(0, 60, 3):  # linked with one other text each
        words = rows[k][1].split()
        words[rng.randrange(62, 80)] = f"y{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, " ".join(passage[: 55 + k])) for k in range(6)]  # linked with each other
    met, keep = [], jaccard._pairs
    monkeypatch.setattr(jaccard, "_pairs", lambda *a, **b: met.append(keep(*a, **b)) or met[-1])
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    out = jaccard.groups(frame(spark, rows)).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in out) == brute(rows)
    assert sum(p.count() for p in met[jaccard.ROUNDS :]) < 4000  # of 53,000


def test_bitmaps_never_part_sets_that_link():
    rng = np.random.default_rng(3)
    for n in (5, 30, 400, 5000):
        for _ in range(30):
            pool = rng.integers(0, 2**63, n + n // 4 + 1).astype(np.uint64)
            a = pool[:n]
            b = np.concatenate([a[rng.random(n) < rng.choice([0.7, 0.85, 0.95, 1])], pool[n : n + rng.integers(0, n // 4 + 1)]])
            both = len(np.intersect1d(a, b))
            differ = sum(int(x ^ y).bit_count() for x, y in zip(jaccard._bitmap(a).view(np.uint64).tolist(), jaccard._bitmap(b).view(np.uint64).tolist()))
            assert differ <= len(a) + len(b) - 2 * both
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert 9 * differ <= len(a) + len(b)


def test_one_of_each_keeps_columns_of_any_name_and_type(spark):
    schema = "doc_id long, text string, row string, own long, digest string, `a.b` map<string,long>, bare boolean"
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(2, text, "r2", 7, "d", {"k": 1, "l": 2}, True), (1, text, "r1", 8, None, None, False), (1, text, "r0", 9, "e", {"k": 3}, None)]
    rows += [(None, text, "n", 1, "x", {}, True), (None, None, "e", 4, "y", None, None), (3, "other", None, None, None, {"z": 0}, None)]
    df = spark.createDataFrame(rows, schema)
    out = jaccard.one_of_each(df)
    assert out.schema == df.schema
    got = {(r["doc_id"], r["row"], r["own"]) for r in out.collect()}
    assert got in ({(1, "r1", 8), (None, "e", 4), (3, None, None)}, {(1, "r0", 9), (None, "e", 4), (3, None, None)})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    labels = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_of_each_keeps_texts_of_repeated_and_missing_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, c), (None, a), (None, d), (None, d + " e"), (None, None), (None, " "), (8, ""), (8, None)]
    out = sorted((repr(r["doc_id"]), r["text"] or "") for r in jaccard.one_of_each(frame(spark, rows + [(5, b)])).collect())
    texts = [(i, t) for i, t in out if t.strip()]
    assert texts[:3] == [("3", a), ("5", b), ("5", c)]
    assert len(texts) == 4 and texts[3][0] == "None" and texts[3][1] in (d, d + " e")
    assert sorted(i for i, t in out if not t.strip()) == ["8", "None", "None"]
    again = jaccard.one_of_each(frame(spark, rows[::-1])).collect()
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in again) == out
