import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, frame

from fenceline.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, query in queries.items():
        found = []
        for i, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in query
                if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def zipf(rng, n, words=300):
    weights = [1 / (k + 1) for k in range(words)]
    return " ".join(rng.choices([f"w{k}" for k in range(words)], weights, k=n))


def local(docs, items, k, size, joint=None):
    """The operator's parts without Spark, shard by shard; (rows, postings read)."""
    shards = [docs[a : a + size] for a in range(0, len(docs), size)]
    shards = [search.Shard.of([i for i, _ in s], [(t or "").encode() for _, t in s]) for s in shards]
    n_docs, n_terms = sum(int((s.lengths > 0).sum()) for s in shards), sum(int(s.lengths.sum()) for s in shards)
    queries = [(i, np.unique(search.term_rows([t.encode()])[0])) for i, t in items]
    terms = np.unique(np.concatenate([q for _, q in queries]))
    df = np.array([sum(int(np.diff(s.starts)[s.terms == t].sum()) for s in shards) for t in terms])
    block = search.block_of(queries, terms, np.array([search.weight(n_docs, d) if d else 0 for d in df]))
    best, read = [search.Best(k) for _ in items], 0
    for s in shards:
        lists = search.lists_of(s, block, n_docs, n_terms)
        if joint is not None:
            lists.joint[:] = joint
        for own, chain, links in zip(best, block.chains, block.links):
            read += search.search(lists, chain, links, own)
    out = [(item, r, i, s) for (item, _), b in zip(items, best) for r, (i, s) in enumerate(zip(b.ids.tolist(), b.scores.tolist()), 1)]
    return sorted(out, key=repr), read


@pytest.mark.parametrize("k", [1, 5, 50])
def test_skipping_loses_nothing(k):
    rng = random.Random(k)
    docs = [(i, zipf(rng, rng.randint(1, 80))) for i in range(600)] + [(600 + i, "w5 w7 w9") for i in range(80)]
    items = [(i, zipf(rng, rng.randint(1, 25))) for i in range(30)] + [(99, "w5 w7 absent"), (98, docs[3][1])]
    for size in (40, 1000):
        assert local(docs, items, k, size)[0] == brute(docs, items, k)


def test_pair_bounds_skip_more_than_single_maxima():
    rng = random.Random(9)
    docs = [(i, zipf(rng, rng.randint(20, 60), 2000)) for i in range(1500)]
    items = [(i, zipf(rng, 12, 2000)) for i in range(40)]
    with_pairs, single = local(docs, items, 5, 100), local(docs, items, 5, 100, joint=2**60)
    assert with_pairs[0] == single[0] and with_pairs[1] < single[1]


def test_bounds_hold_for_every_document():
    rng = np.random.default_rng(4)
    for _ in range(300):
        gains = rng.integers(0, 50, (20, 9)) * (rng.random((20, 9)) < 0.4)
        highest = gains.max(axis=0).tolist()
        joint = [max((int(g[k] + g[k + 1]) for g in gains if g[k] and g[k + 1]), default=0) for k in range(8)]
        limit = search.bounds(highest, joint)
        assert limit == sorted(limit)
        for k in range(10):
            assert gains[:, :k].sum(axis=1).max() <= limit[k] <= sum(highest[:k])


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(search, "PASS", 50)
    rng = random.Random(2)
    docs = [(i, zipf(rng, n)) for i, n in enumerate([300, 1, 40, 500])] + [(9, "x" * 400), (10, ""), (11, "a." * 90)]
    items = [(0, "w1 w2 w3 a"), (1, "x" * 400)]
    assert local(docs, items, 50, 3)[0] == brute(docs, items, 50)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    docs = awkward() + [(300 + i, zipf(rng, 30, 40)) for i in range(200)] + [(1000 + i, "The cat W1 w2") for i in range(120)]
    items = [(0, "the CAT, w1 w2 w3 und"), (1, None), (2, ""), (3, "nothing of this"), (None, "w7 w8"), (4, "w9"), (4, "W10 idiot"), (5, docs[4][1])]
    items += [(10 + i, zipf(rng, 8, 40)) for i in range(20)]
    frames = frame(spark, docs), spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank long, score string")
    got = sorted((tuple(r) for r in search.ranked(*frames).collect()), key=repr)
    assert got == brute(docs, items, 50)
    assert len({r[0] for r in got}) > 20
    # Several blocks of queries give the same rows.
    blocks = list(search.query_blocks(frames[1], 10))
    assert len(blocks) > 5 and sum(len(b) for b in blocks) == len({i for i, _ in items})


def test_blocks_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(6)
    docs, items = [(i, zipf(rng, 30, 40)) for i in range(60)], [(i, zipf(rng, 8, 40)) for i in range(6)]
    whole = search.query_blocks
    monkeypatch.setattr(search, "query_blocks", lambda df: whole(df, 20))
    frames = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in search.ranked(*frames, k=7).collect()), key=repr) == brute(docs, items, 7)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.ranked(frame(spark, []).limit(0), items).count() == 0
    assert search.ranked(frame(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert search.ranked(frame(spark, [(1, None), (2, ". ,")]), items).count() == 0
