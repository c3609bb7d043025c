import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, frame
from tokenizers import Tokenizer

from fenceline.llm import patterns


def histogram(lengths):
    return np.bincount(lengths, minlength=2049)


def used(plan):
    out = np.zeros(2049, dtype=np.int64)
    for times, pattern in plan:
        assert times > 0 and sum(n * each for n, each in pattern) <= 2048
        for n, each in pattern:
            out[n] += times * each
    return out


def test_fillings_are_all_sums():
    found = list(patterns.fillings(12, 3))
    wanted = {(a, b, c) for a in range(13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12}
    assert len(found) == len(set(found)) and {p + (0,) * (3 - len(p)) for p in found} == wanted


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.integers(0, 3, (12, 40)).astype(float), rng.integers(0, 50, 12).astype(float)
        x = patterns.nnls(a, b)
        slope = a.T @ (b - a @ x)
        # At the minimum no column at zero would help, and no column in use can be improved.
        assert (x >= 0).all() and (slope <= 1e-6).all() and (np.abs(slope[x > 0]) < 1e-5).all()
    assert patterns.nnls(np.ones((3, 2)), np.zeros(3)).tolist() == [0, 0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_once_and_nearly_fills(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1, 30_000).astype(int), 1, 2048)
    lengths[:3000] = 700  # one length is frequent
    h = histogram(lengths)
    plan = patterns.plan(h)
    assert (used(plan) == h).all()
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert sum(times for times, _ in plan) <= 1.005 * least + 1
    # Most sequences come from the fitted patterns where the lengths allow it.
    fitted = sum(times for times, _ in patterns.repeats(h))
    assert fitted > 0.5 * least


@pytest.mark.parametrize("lengths", [[], [1], [2048] * 5, [1025] * 7, [1] * 5000, [2048, 1, 1024, 1024], [3] * 683 + [2]])
def test_plan_of_small_histograms(lengths):
    h = histogram(np.array(lengths, dtype=int))
    plan = patterns.plan(h)
    assert (used(plan) == h).all()
    long = sum(n > 1024 for n in lengths)
    assert sum(times for times, _ in plan) <= max(-(-sum(lengths) // 2048), long) + 1


def test_places_number_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 4000)
    places = patterns.Places.of(patterns.plan(histogram(lengths)))
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    number = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
    sequence, offset = places.find(ranked, number)
    spans = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), ranked.tolist()):
        spans[s].append((o, n))
    for found in spans.values():
        at = 0
        for o, n in sorted(found):
            assert o == at
            at += n
        assert at <= 2048


def test_every_id_once(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = awkward() + [(500, "hello world " * 4000), (501, "a <|endoftext|> b"), (502, "ɐ日本 😀 x " * 3000)]
    rows += [(600 + i, "same text") for i in range(400)]  # a length that most rows share
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in patterns.pack(frame(spark, rows)).collect():
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    wanted = defaultdict(Counter)
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for k, n in enumerate(patterns.cuts(len(ids))):
            wanted[i][(k, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
            start += n
        assert start == len(ids)
    assert {i: Counter((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in found) for i, found in docs.items()} == wanted
    assert len(sequences) <= -(-sum(p["length"] for s in sequences.values() for p in s) // 2048) + 1
    assert patterns.pack(frame(spark, []).limit(0)).count() == 0


def test_result_does_not_depend_on_the_order_of_neighbours():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2048) for _ in range(500)]
    assert patterns.plan(histogram(np.array(lengths))) == patterns.plan(histogram(np.array(lengths[::-1])))
