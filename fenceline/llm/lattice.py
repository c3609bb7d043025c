"""Language-model scores that sum over all segmentations of a text into vocabulary pieces.

The pieces are those of a public vocabulary; a word is its bytes behind one space, and single bytes cover what
no piece does. Piece probabilities come from the distinct words of all training documents by expectation steps
over the lattice of each. A training word is one more arc across its whole lattice, weighted by its count less
an absolute discount; the discounted mass is what the pieces share. A document's probability is the product
over its words of the forward sum over all segmentations, computed in logarithms, and of the end token.

Documents are stored in blocks. Each block sends its distinct words with their training counts to word
fragments; a fragment adds the counts up, scores each word once, and sends both back to the blocks that have
it. Nothing larger than the fixed vocabulary reaches the driver.

Words of any length are summed over whole; long ones walk their lattice in blocks of positions.

A null or empty text is the end token alone. A null id counts as training. Repeated rows count each. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

import functools
import math
import zlib
from array import array
from collections import defaultdict
from itertools import count

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.llm import blocks, common
from fenceline.sources.shared import materialize

#: Text bytes behind one word fragment.
FRAGMENT = 48_000_000
STEPS = 3
#: Added to the expected count of each piece.
SMOOTHING = 0.5
LONGEST_PIECE = 16
#: Words of more bytes are walked one by one, so many positions at a time; memory stays a few dozen bytes a byte.
LONG_WORD = 2000
POSITIONS = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces as sorted hashes; the last entry is the end piece, which matches nothing."""

    def __init__(self, name: str):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = {bytes([b]): 100_000 + b for b in range(256)}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).replace("▁", " ")
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or " " in piece[1:]:
                continue
            raw = piece.encode()
            if len(raw) <= LONGEST_PIECE:
                pieces[raw] = i
        found = sorted((int(self._hash(p)), rank) for p, rank in pieces.items())
        self.hashes = np.array([h for h, _ in found], dtype=np.uint64)
        # Before any counting, an earlier piece of the vocabulary is likelier.
        start = np.array([1 / (100 + rank) for _, rank in found] + [1e-4])
        self.start = np.log(start / start.sum())

    @staticmethod
    def _hash(piece: bytes) -> np.uint64:
        with np.errstate(over="ignore"):
            h = np.uint64(0)
            for b in piece:
                h = h * _BASE + np.uint64(b + 1)
        return h


@functools.cache
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def _lattice(words: np.ndarray, vocab: Vocabulary):
    """For words of one length as a byte matrix: piece index by (start, length), -1 where there is none."""
    n, length = words.shape
    prefix = np.zeros((length + 1, n), dtype=np.uint64)
    for j in range(length):
        prefix[j + 1] = prefix[j] * _BASE + words[:, j] + np.uint64(1)
    power = np.uint64(1)
    out = {}
    for size in range(1, min(LONGEST_PIECE, length) + 1):
        power = np.uint64(int(power) * int(_BASE) % 2**64)
        for i in range(length - size + 1):
            h = prefix[i + size] - prefix[i] * power
            at = np.searchsorted(vocab.hashes, h)
            at[at == len(vocab.hashes)] = 0
            out[i, size] = np.where(vocab.hashes[at] == h, at, -1)
    return out


def _by_length(words: list[bytes]):
    """Positions and byte matrix of words of equal length, in batches of bounded size; long words are left out."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for length in np.unique(lengths[lengths <= LONG_WORD]):
        where = np.flatnonzero(lengths == length)
        most = max(1, 1_500_000 // int((length + 1) * min(length + 1, LONGEST_PIECE)))
        for first in range(0, len(where), most):
            at = where[first : first + most]
            raw = b"".join(b" " + words[i] for i in at)
            yield at, np.frombuffer(raw, np.uint8).reshape(len(at), length + 1).astype(np.uint64)


def _forward(lattice: dict, logs: np.ndarray, n: int, length: int) -> list[np.ndarray]:
    alpha = [np.zeros(n)] + [np.full(n, -np.inf) for _ in range(length)]
    for j in range(1, length + 1):
        for size in range(1, min(LONGEST_PIECE, j) + 1):
            # logs[-1] of the extended array is minus infinity: no piece there.
            alpha[j] = np.logaddexp(alpha[j], alpha[j - size] + logs[lattice[j - size, size]])
    return alpha


def _long(words: list[bytes]):
    """Position and bytes, behind one space, of each long word."""
    for at, word in enumerate(words):
        if len(word) > LONG_WORD:
            yield at, np.frombuffer(b" " + word, np.uint8).astype(np.uint64)


def _arcs(word: np.ndarray, vocab: Vocabulary, first: int):
    """Start, size and piece of every arc of one word from the starts ``first`` to ``first + POSITIONS``, by start."""
    last = min(first + POSITIONS, len(word))
    hashes, found = np.zeros(last - first, dtype=np.uint64), []
    for size in range(1, LONGEST_PIECE + 1):
        starts = np.arange(first, min(last, len(word) - size + 1))
        hashes = hashes[: len(starts)] * _BASE + word[starts + size - 1] + np.uint64(1)
        at = np.minimum(np.searchsorted(vocab.hashes, hashes), len(vocab.hashes) - 1)
        hit = vocab.hashes[at] == hashes
        found.append((starts[hit], np.full(int(hit.sum()), size), at[hit]))
    start, size, piece = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(start, kind="stable")
    return start[order], size[order], piece[order]


def _add_logs(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _long_forward(word: np.ndarray, logs: np.ndarray, vocab: Vocabulary) -> array:
    """Log probability of every prefix of one word."""
    alpha = array("d", [0.0]) + array("d", [-math.inf]) * len(word)
    for first in range(0, len(word), POSITIONS):
        start, size, piece = _arcs(word, vocab, first)
        for i, j, weight in zip(start.tolist(), (start + size).tolist(), logs[piece].tolist()):
            alpha[j] = _add_logs(alpha[j], alpha[i] + weight)
    return alpha


def _long_expected(word: np.ndarray, logs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected number of times one word uses each piece; suffixes are summed from the end, block by block."""
    total = np.zeros(len(vocab.hashes) + 1)
    forward = _long_forward(word, logs, vocab)
    beta = array("d", [-math.inf]) * len(word) + array("d", [0.0])
    for first in range((len(word) - 1) // POSITIONS * POSITIONS, -1, -POSITIONS):
        start, size, piece = _arcs(word, vocab, first)
        weights = logs[piece]
        for i, j, weight in zip(start[::-1].tolist(), (start + size)[::-1].tolist(), weights[::-1].tolist()):
            beta[i] = _add_logs(beta[i], weight + beta[j])
        after = np.array(beta[first : first + POSITIONS + LONGEST_PIECE])[start + size - first]
        used = np.exp(np.frombuffer(forward)[start] + weights + after - forward[-1])
        total += np.bincount(piece, weights=used, minlength=len(total))
    return total


def marginals(words: list[bytes], logs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Natural log of the summed probability of all segmentations, per word."""
    out = np.zeros(len(words))
    logs = np.append(logs[: len(vocab.hashes)], -np.inf)
    for at, matrix in _by_length(words):
        out[at] = _forward(_lattice(matrix, vocab), logs, *matrix.shape)[-1]
    for at, word in _long(words):
        out[at] = _long_forward(word, logs, vocab)[-1]
    return out


def expected(words: list[bytes], counts: np.ndarray, logs: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected number of times each piece is used by the counted words."""
    total = np.zeros(len(vocab.hashes) + 1)
    logs = np.append(logs[: len(vocab.hashes)], -np.inf)
    for at, matrix in _by_length(words):
        n, length = matrix.shape
        lattice, weight = _lattice(matrix, vocab), counts[at].astype(float)
        alpha = _forward(lattice, logs, n, length)
        beta = [np.full(n, -np.inf) for _ in range(length)] + [np.zeros(n)]
        for i in range(length - 1, -1, -1):
            for size in range(1, min(LONGEST_PIECE, length - i) + 1):
                piece = lattice[i, size]
                through = logs[piece] + beta[i + size]
                beta[i] = np.logaddexp(beta[i], through)
                used = weight * np.exp(alpha[i] + through - alpha[-1])
                total += _count(piece, used, len(total))
    for at, word in _long(words):
        total += counts[at] * _long_expected(word, logs, vocab)
    total[-1] = 0
    return total


def _count(piece: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
    real = piece >= 0
    return np.bincount(piece[real], weights=used[real], minlength=n)


def _numbered(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Distinct words in order of appearance, and each text as their numbers. A-Z become lower case."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(known.__getitem__, t.lower().split()), dtype=np.int64) for t in texts]
    return list(known), rows


def _fragments(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % n


def document_scores(docs: DataFrame, vocab_name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    packed = blocks.pack(docs)
    n = max(1, -(-common.text_bytes(docs) // FRAGMENT))

    def send(row):
        ids, texts = blocks.thaw(row["payload"])
        words, numbers = _numbered(texts)
        training = ~common.held_out_rows(ids, 7, 2)
        seen = [x for x, t in zip(numbers, training) if t]
        counts = np.bincount(np.concatenate(seen) if seen else np.zeros(0, np.int64), minlength=len(words))
        fragment = _fragments(words, n)
        for f in range(n):
            own = np.flatnonzero(fragment == f)
            if len(own):
                yield f, row["block"], blocks.freeze(([words[i] for i in own], counts[own].astype(np.uint32)))

    # One row per fragment: its words, their counts, and which words each block asked for, in its order.
    def gather(key, table):
        known: dict[bytes, int] = defaultdict(count().__next__)
        total = np.zeros(0, dtype=np.int64)
        asked = []
        for block, payload in zip(table.column("block").to_pylist(), table.column("words")):
            words, counts = blocks.thaw(payload.as_py())
            at = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
            if len(known) > len(total):
                total = np.concatenate((total, np.zeros(max(len(known), 2 * len(total)) - len(total), np.int64)))
            np.add.at(total, at, counts)
            asked.append((block, at.astype(np.uint32)))
        total = total[: len(known)]
        return blocks.batch_of(
            _GATHERED,
            [
                [key[0].as_py()],
                [blocks.freeze((list(known), total))],
                [blocks.freeze(asked)],
                [int(total.sum())],
                [int((total > 0).sum())],
                [int((total == 1).sum())],
                [int((total == 2).sum())],
            ],
        )

    sent = packed.mapInArrow(blocks.per_row(send, "fragment long, block long, words binary"), "fragment long, block long, words binary")
    gathered = materialize(sent.groupBy("fragment").applyInArrow(gather, _GATHERED), "words")

    training = docs.where(F.col("doc_id").isNull() | (common.remainder(F.col("doc_id"), 7) != 2)).count()
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_types", "n_once", "n_twice")]
    tokens, types, once, twice = gathered.agg(*sums).first()
    tokens, types = tokens + training, types + (training > 0)

    logs = vocabulary(vocab_name).start
    for _ in range(STEPS):

        def expect(batches, logs=logs):
            vocab, total = vocabulary(vocab_name), None
            for batch in batches:
                for payload in batch.column("words"):
                    words, counts = blocks.thaw(payload.as_py())
                    seen = np.flatnonzero(counts > 0)
                    found = expected([words[i] for i in seen], np.ones(len(seen)), logs, vocab)
                    total = found if total is None else total + found
            if total is not None:
                at = np.flatnonzero(total)
                yield blocks.batch_of("piece int, n double", [at, total[at]]).to_batches()[0]

        # As many rows as the vocabulary has pieces.
        counted = gathered.select("words").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        pieces = np.full(len(logs), SMOOTHING)
        for row in counted.collect():
            pieces[row["piece"]] += row["n"]
        logs = np.log(pieces / pieces.sum())

    # Absolute discount from the numbers of words seen once and twice.
    discount = once / (once + 2 * twice) if once + twice else 0.5
    shared = np.log(discount * types / tokens) if tokens else 0.0

    def answer(row):
        words, counts = blocks.thaw(row["words"])
        by_pieces = shared + marginals(words, logs, vocabulary(vocab_name))
        whole = np.maximum(counts - discount, 0) / max(tokens, 1)
        with np.errstate(divide="ignore"):
            values = np.logaddexp(np.log(whole), by_pieces) / np.log(10)
        for block, at in blocks.thaw(row["asked"]):
            yield block, row["fragment"], blocks.freeze((counts[at], values[at]))

    answers = gathered.select("fragment", "words", "asked").mapInArrow(
        blocks.per_row(answer, "block long, fragment long, found binary"), "block long, fragment long, found binary"
    )
    floor = np.log10(float(tokens + types + 1))
    end_base = np.log10(training + 1) - floor
    # Without training rows the end is one more symbol beside the pieces.
    end_score = np.log10((training - discount) / tokens) if training else -np.log10(len(logs))

    def score(key, block, found):
        ids, texts = blocks.thaw(block.column("payload")[0].as_py())
        words, numbers = _numbered(texts)
        fragment = _fragments(words, n)
        counts, values = np.zeros(len(words), np.int64), np.zeros(len(words))
        for f, payload in zip(found.column("fragment").to_pylist(), found.column("found")):
            own = np.flatnonzero(fragment == f)
            counts[own], values[own] = blocks.thaw(payload.as_py())
        base, known = np.log10(counts + 1.0) - floor, counts > 0
        return blocks.batch_of(
            SCORED,
            [
                ids,
                common.held_out_rows(ids, 7, 2),
                [len(x) + 1 for x in numbers],
                [int(known[x].sum()) + (training > 0) for x in numbers],
                [tokens] * len(ids),
                [float(base[x].sum() + end_base) for x in numbers],
                [float(values[x].sum() + end_score) for x in numbers],
            ],
        )

    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORED)


_GATHERED = "fragment long, words binary, asked binary, n_words long, n_types long, n_once long, n_twice long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
