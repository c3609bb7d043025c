import hashlib
import random
import zlib
from collections import Counter

import pytest

from fenceline.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, rank string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    i, text, lang, source, n = row[:5]
    values = [i, source, lang, n if n is None else n + add, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings_of(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else "", at & 1))
        at >>= 1
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels_of([leaf(r) for r in own])
    top = levels_of([trees[lang][1][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            way = siblings_of(levels, at) + siblings_of(top, place)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1 if tampered else 0)
            for s, right in way:
                folded = sha(s, folded) if right else sha(folded, s)
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[-1][0], root, sha(*[s for s, _ in way]), folded, folded == root))
    return Counter(out)


def table(n, langs, seed=3):
    rng = random.Random(seed)
    rows = [(i * 2, f"text {i} é", rng.choice(langs), rng.choice(["a", None]), rng.choice([None, i])) for i in range(n)]
    return rows


@pytest.mark.parametrize("levels", [3, 12])
def test_equals_brute_force(spark, monkeypatch, levels):
    """Small segments give many heights, also above the subroots."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    langs = ["en"] * 40 + ["de", "é", "Z", "", None] + [f"l{k}" for k in range(12)]
    rows = table(300, langs)
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 1), (7, "", "only", "", 0), (7, "", "only", "", 0), rows[5], (8, "long " * 50_000, "en", "s", 5)]
    rows = [(*r, 1, "own") for r in rows]
    got = manifest.proofs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(*r, None, None) for r in table(n, ["en"])]
    got = manifest.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_sql_equals_brute_force():
    duckdb = pytest.importorskip("duckdb")
    rows = table(90, ["en"] * 40 + ["de", "é", "", None, "x"]) + [(7001, None, "lone", None, None)]
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert Counter(con.sql(manifest.SQL).fetchall()) == brute(rows)


def test_empty(spark):
    assert manifest.proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_survive_storage():
    tops, records = manifest.grow([sha(str(k)) for k in range(11)], 4)
    assert len(tops) == 1 and manifest.thawed(manifest.frozen(records)) == records


def test_any_change_is_seen():
    nodes = [sha(str(k)) for k in range(13)]
    (root,), records = manifest.grow(nodes, 4)
    for at, node in enumerate(nodes):
        reached, passed = manifest.walk(records, root, at, 4)
        assert reached == node
        assert manifest.fold(node, at, passed[::-1]) == root
        assert manifest.fold(sha("other"), at, passed[::-1]) != root
        for k, s in enumerate(passed):
            if s:
                wrong = passed[:k] + [sha(s)] + passed[k + 1 :]
                assert manifest.fold(node, at, wrong[::-1]) != root
