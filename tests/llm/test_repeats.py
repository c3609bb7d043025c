import hashlib
import random

import numpy as np
from helpers import awkward, frame

from fenceline.llm import repeats


def brute(rows):
    """(bytes, removed, runs, digest) per row; a null id is larger than all others."""
    texts = [((i is None, i or 0), (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in sorted(texts):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = []
    for (i, _), (key, t) in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < key:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((repr(i), len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(5)
    draw = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pool = [draw(rng.randint(40, 130), "ab ") for _ in range(25)]
    rows = awkward()
    for i in range(150):
        parts = [rng.choice(pool)[rng.randint(0, 20) : rng.randint(60, 130)] if rng.random() < 0.6 else draw(rng.randint(0, 60), "abcdé \x00")
                 for _ in range(rng.randint(0, 7))]
        rows.append((2000 + i * 3, "".join(parts)))
    rows += [(9003, "x" * 500), (9004, "x" * 49), (9005, "x" * 50), (9006, "yx" * 40), (9007, pool[0] * 40)]
    rng.shuffle(rows)
    return rows


def test_removals_match_brute_force(spark, monkeypatch):
    rows = fixture()
    want = brute(rows)
    for block, fragment in ((8_000_000, 12_000_000), (3_000, 4_000)):
        monkeypatch.setattr(repeats, "BLOCK", block)
        monkeypatch.setattr(repeats, "FRAGMENT", fragment)
        out = repeats.removals(frame(spark, rows)).collect()
        assert sorted((repr(r[0]), *tuple(r)[1:]) for r in out) == want
    assert repeats.removals(frame(spark, []).limit(0)).count() == 0


def test_intervals_are_the_maximal_runs():
    shared = [2, 5, 5, 1, 0, 3, 3]
    got = sorted(repeats.intervals(shared, 1))
    assert got == [(1, 0, 4), (2, 0, 3), (3, 5, 7), (5, 1, 3)]


def test_maximal_repeats_hold_all_occurrences():
    tail = b"R" * 30
    lefts = [b"abcdef" + b"L" * 28, b"ghidef" + b"L" * 28, b"xyzuvw" + b"M" * 28]
    left = np.array([list(x[::-1]) for x in lefts], np.uint8)
    right = np.array([list((b"anchor_16_bytes!" + tail + bytes([k]) * 4)) for k in (65, 66, 67)], np.uint8)
    found = [(m, d, sorted(c.tolist())) for m, d, c in repeats.maximal_repeats(left, np.full(3, 34), right, np.full(3, 50))]
    assert found == [(31, 46, [0, 1])]


def test_without_repeats_keeps_columns_and_valid_text(spark):
    passage = "é" * 60
    docs = frame(spark, [(1, passage + " one"), (2, "two " + passage + " x"), (2, "two " + passage + " x"), (3, None)])
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == [(1, passage + " one"), (2, "two x"), (2, "two x"), (3, "")]


def test_without_repeats_keeps_columns_of_any_name_and_type(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    schema = "block long, text string, doc_id int, rest map<string,array<int>>, key timestamp, rows struct<a:string,b:date>, n_chars int"
    passage = "a passage that two documents have, of more than fifty bytes " * 2
    rows = [(k, f"{passage} tail {k}" if k % 2 else None if k % 4 else f"own {k}", k, {"x": [k, None]}, None, ("s", None), 5) for k in range(20)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = repeats.without_repeats(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    for r in rows:
        text = r[1] if r[2] == 1 or not r[1] or "own" in r[1] else got[r[2]]["text"]
        assert got[r[2]]["text"] == text and got[r[2]]["n_chars"] == (None if text is None else len(text))
        assert tuple(got[r[2]])[3:6] == (r[3], None, ("s", None)) and got[r[2]]["block"] == r[0]
    assert all(len(got[k]["text"]) < 10 for k in range(3, 20, 2))
    assert repeats.without_repeats(docs.limit(0)).count() == 0
