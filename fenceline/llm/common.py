"""Helpers shared by the corpus operators."""

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def _give_back() -> None:
    """Let arrays over 1 MB go back to the system when freed: Python workers live on between tasks, and the
    C library otherwise keeps what earlier groups needed. Does nothing where it has no such setting."""
    set_option = getattr(ctypes.CDLL(None), "mallopt", None)
    if set_option:
        set_option(-3, 1 << 20)  # M_MMAP_THRESHOLD


_give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string")) % m


def held_out_rows(ids, m: int, r: int) -> np.ndarray:
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % m == r for i in ids], dtype=bool)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts, to size groups by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


# --- word and n-gram hashes over many texts at once -------------------------------------------------

_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _BASE modulo 2^64.
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def finish(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes], lower: bool = True, breaks: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text's words begin (one more
    entry than texts). ``lower`` folds A-Z; ``breaks`` says which bytes part words, the blank among them. A word
    never crosses texts."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = breaks[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    limits = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    bounds = np.concatenate(([0], np.searchsorted(starts, limits)))
    values = _MIX[_FOLD[raw] if lower else raw]
    # A polynomial over a whole block needs powers only as long as the block.
    values *= _powers(_BASE, len(values))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * _powers(_BACK, len(raw))[starts] if len(starts) else np.zeros(0, np.uint64)
    return finish(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), bounds


def shingle_hashes(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the whole sequence where it is shorter; none without words."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k * 0x9FB21C651E98DF25 % 2**64, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0xE7037ED1A0B428DB)
        out ^= out >> np.uint64(31)
    return finish(out)


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts ``values``, where each distinct value begins in it, and the number of its group for
    every value as given."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def blocks(ids, texts, most: int = 4_000_000, encoded: bool = False) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in runs of about ``most`` text bytes; a longer text is a run of its own."""
    out_ids, out, size = [], [], 0
    for i, t in zip(ids, texts):
        t = (t if encoded else t.encode()) if t else b""
        if out and size + len(t) > most:
            yield out_ids, out
            out_ids, out, size = [], [], 0
        out_ids.append(i)
        out.append(t)
        size += len(t)
    if out:
        yield out_ids, out
