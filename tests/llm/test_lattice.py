import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, frame

from fenceline.llm import lattice


def paths(word, pieces):
    """Summed probability of all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(pieces[word[:k]] * paths(word[k:], pieces) for k in range(1, len(word) + 1) if word[:k] in pieces)


def test_marginals_and_expectations_match_enumeration():
    vocab = lattice.vocabulary("piece_bpe_32k.model")
    logs = vocab.start
    index = {int(h): k for k, h in enumerate(vocab.hashes)}

    class Pieces(dict):
        def __contains__(self, piece):
            return int(lattice.Vocabulary._hash(piece)) in index

        def __getitem__(self, piece):
            return math.exp(logs[index[int(lattice.Vocabulary._hash(piece))]])

    words = [b"the", b"thing", "naïve".encode(), b"x", b"zzq", b"the"]
    got = lattice.marginals(words, logs, vocab)
    for w, g in zip(words, got):
        assert g == pytest.approx(math.log(paths(b" " + w, Pieces())), abs=1e-9)
    total = lattice.expected([b"the"], np.ones(1), logs, vocab)
    # Raising a piece's log probability by d raises the word's by d times its expected count.
    k = int(np.argmax(total))
    moved = logs.copy()
    moved[k] += 1e-6
    assert (lattice.marginals([b"the"], moved, vocab)[0] - got[0]) / 1e-6 == pytest.approx(total[k], abs=1e-4)


def test_long_words_in_blocks_equal_the_whole_lattice(monkeypatch):
    vocab = lattice.vocabulary("piece_bpe_32k.model")
    words = [b"the", b"aGVsbG8gd29ybGQ" * 20, "日本語のテキスト".encode() * 9, bytes(range(128, 256))]
    counts = np.array([1, 2, 3, 1])
    whole = lattice.marginals(words, vocab.start, vocab), lattice.expected(words, counts, vocab.start, vocab)
    monkeypatch.setattr(lattice, "LONG_WORD", 10)
    for positions in (7, 16, 100_000):
        monkeypatch.setattr(lattice, "POSITIONS", positions)
        np.testing.assert_allclose(lattice.marginals(words, vocab.start, vocab), whole[0], rtol=1e-10)
        np.testing.assert_allclose(lattice.expected(words, counts, vocab.start, vocab), whole[1], rtol=1e-7, atol=1e-12)


def test_word_of_a_megabyte():
    vocab = lattice.vocabulary("piece_bpe_32k.model")
    word = np.random.default_rng(1).integers(97, 123, 1_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    total = lattice.expected([word[:200_000]], np.ones(1), vocab.start, vocab)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The expected pieces cover the word and its space; memory is that of one block of positions.
    assert peak < 60_000_000
    assert 200_001 / lattice.LONGEST_PIECE < total.sum() < 200_002
    assert math.isfinite(lattice.marginals([word], vocab.start, vocab)[0])


def test_base_counts_and_probabilities(spark):
    rows = awkward()
    out = lattice.document_scores(frame(spark, rows)).collect()
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    training = [w for i, w in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(x for w in training for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (repr(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))
        for i, w in docs
    )
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    # One word's probabilities are a share of 1: words seen and the rest.
    assert lattice.document_scores(frame(spark, []).limit(0)).count() == 0
