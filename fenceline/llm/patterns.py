"""Best-fit packing by patterns of lengths.

Documents longer than a sequence are cut, the short piece first. What is packed is then only a histogram of
piece lengths, at most 2048 numbers whatever the size of the corpus:

1. Lengths are put into bins of 16, and every way to fill a sequence with up to three bins is a pattern.
2. Non-negative least squares finds how often each pattern is to be repeated so that together they use up the
   histogram; repeats are rounded down.
3. A pattern takes actual lengths from its bins; its last place takes the longest length that still fits.
   Repeats that do not fill their sequence are given back.
4. What is left, the residual, is packed by best fit, longest first, into the gaps and into new sequences, many
   equal lengths in one step.

The plan says for the j-th piece of a length which sequence and place it has, so every piece finds its own place
without meeting its neighbours. j counts the pieces of a length inside each input partition, and an offset per
(partition, length) from a running sum over partitions, so a length that a third of all pieces share is no group.

A null text counts as empty and has the end id alone. Rows that repeat, share an id or have none are packed
each on its own. An empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.llm.packing import document_ids
from fenceline.sources.shared import materialize

LENGTH = 2048
#: Width of a bin of lengths; documents in a pattern.
BIN, MOST = 16, 3
#: Ids a pattern's repeat may leave empty; others go to the residual.
GAP = 0
#: Documents whose texts are held at once, pieces sent on at once.
ROWS, OUT = 256, 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

#: Lengths of one sequence in order, as runs (length, how many).
Pattern = tuple[tuple[int, int], ...]


# --- pieces -----------------------------------------------------------------------------------------


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: whole sequences behind what is left over."""
    first = total % length
    return [first] * (first > 0) + [length] * (total // length)


def _measured(name: str, length: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        rows: list[tuple] = []

        def out():
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
            return pa.RecordBatch.from_arrays(arrays, _NAMES)

        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids, start = document_ids(text.as_py(), name), 0
                    for k, n in enumerate(cuts(len(ids), length)):
                        crc = zlib.crc32(ids[start : start + n].tobytes())
                        rows.append((doc_id, k, start, n, crc, part, int(seen[n])))
                        seen[n] += 1
                        start += n
                    if len(rows) >= OUT:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return run


def measured(docs: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """A stored row per piece with its number ``nth`` among the pieces of its length in input partition ``part``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return materialize(rows.mapInArrow(_measured(name, length), PIECES), "pieces")


# --- the plan ---------------------------------------------------------------------------------------


def fillings(total: int, parts: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
    """All ways to write ``total`` as a sum of at most ``parts`` positive numbers, largest first."""
    if total == 0:
        yield ()
    elif parts:
        for first in range(min(total, most or total), 0, -1):
            if first * parts < total:
                return
            for rest in fillings(total - first, parts - 1, first):
                yield (first, *rest)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |ax - b|, by growing a set of free columns (Lawson and Hanson)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(20 * len(b)):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= small:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            wanted = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = wanted <= small * 1e-3
            if not low.any():
                x[:] = 0
                x[at] = wanted
                break
            # Go towards the solution until the first free column reaches zero, and hold it there.
            gap = x[at][low] - wanted[low]
            step = float(np.min(np.where(gap > 0, x[at][low] / np.where(gap > 0, gap, 1), 0)))
            x[at] += step * (wanted - x[at])
            held = at[(x[at] <= small * 1e-3) & low]
            if not len(held):
                held = at[low][:1]
            x[held] = 0
            free[held] = False
            if not free.any():
                break
    return x


def repeats(histogram: np.ndarray, width: int = BIN, most: int = MOST) -> list[tuple[int, tuple[int, ...]]]:
    """How often each pattern of bins is used, by least squares and rounding down. ``histogram[n]`` counts length n."""
    bins = (len(histogram) - 1) // width
    counts = histogram[1 : bins * width + 1].reshape(bins, width).sum(axis=1).astype(float)
    there = counts > 0
    # A length lies half a bin below its bin's upper edge on average, so k lengths fill what k / 2 more bins name.
    sizes = ((k, p) for k in range(1, most + 1) for p in fillings(bins + k // 2, k) if len(p) == k)
    candidates = [p for _, p in sizes if p[0] <= bins and all(there[n - 1] for n in p)]
    if not candidates:
        return []
    a = np.zeros((bins, len(candidates)))
    for k, pattern in enumerate(candidates):
        for n in pattern:
            a[n - 1, k] += 1
    # Wide bins hold more tokens, so they weigh more.
    weight = np.sqrt(np.arange(1, bins + 1))[:, None]
    x = np.floor(nnls(a * weight, counts * weight[:, 0]) + 1e-6).astype(int)
    return [(int(n), candidates[k]) for k, n in enumerate(x) if n]


def _runs(lengths: list[int]) -> Pattern:
    return tuple((n, len(list(same))) for n, same in groupby(lengths))


def _filled(left: np.ndarray, pattern: tuple[int, ...], times: int, width: int) -> Iterator[tuple[int, list[int], int]]:
    """Actual lengths for ``times`` repeats of a pattern, taken from ``left``: (repeats, lengths, room)."""
    *most, last = pattern
    open_ = [(times, [], len(left) - 1)]
    for n in most:
        low, next_ = (n - 1) * width, []
        for count, lengths, room in open_:
            length = min(n * width, room)
            while count:
                while length > low and not left[length]:
                    length -= 1
                if length <= low:  # no length of the bin is left or fits: this place stays a gap
                    next_.append((count, lengths, room))
                    break
                took = min(count, int(left[length]))
                left[length] -= took
                next_.append((took, lengths + [length], room - length))
                count -= took
        open_ = next_
    for count, lengths, room in open_:
        low, length = max(0, last - 3) * width, room
        while count:
            while length > low and not left[length]:
                length -= 1
            if length <= low:
                yield count, lengths, room
                break
            took = min(count, int(left[length]))
            left[length] -= took
            yield took, lengths + [length], room - length
            count -= took


def plan(histogram: np.ndarray, width: int = BIN, most: int = MOST, gap: int = GAP) -> list[tuple[int, Pattern]]:
    """Patterns of actual lengths and their repeats that use up the histogram exactly."""
    left = histogram.astype(np.int64)
    whole = len(left) - 1
    gaps: dict[int, list[tuple[int, Pattern]]] = {}
    rooms: list[int] = []  # the keys of ``gaps`` in order

    def put(count: int, pattern: Pattern, room: int) -> None:
        if room not in gaps:
            bisect.insort(rooms, room)
        gaps.setdefault(room, []).append((count, pattern))

    for times, pattern in repeats(left, width, most):
        for count, lengths, room in list(_filled(left, pattern, times, width)):
            if room <= gap:
                put(count, _runs(lengths), room)
            else:
                np.add.at(left, lengths, count)
    for length in range(whole, 0, -1):
        count = int(left[length])
        while count:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else whole
            if at < len(rooms):
                times, pattern = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                times, pattern = -(-count // (whole // length)), ()
            each = room // length
            took = min(times, count // each)
            if took:
                put(took, pattern + ((length, each),), room - each * length)
                count -= took * each
            elif count:
                took = 1
                put(1, pattern + ((length, count),), room - count * length)
                count = 0
            if times > took and pattern:
                put(times - took, pattern, room)
    return [group for room in rooms for group in gaps[room]]


@dataclass
class Places:
    """The plan by place: runs of pieces of a length, ordered by (length, first piece)."""

    length: np.ndarray
    first: np.ndarray  # number of the run's first piece among those of its length
    each: np.ndarray  # pieces of this run in one sequence
    sequence: np.ndarray  # the run's first sequence
    offset: np.ndarray  # place of the run in its sequences

    @staticmethod
    def of(patterns: list[tuple[int, Pattern]]) -> "Places":
        rows, used, sequence = [], {}, 0
        for times, pattern in patterns:
            offset = 0
            for length, each in pattern:
                rows.append((length, used.get(length, 0), each, sequence, offset))
                used[length] = used.get(length, 0) + times * each
                offset += length * each
            sequence += times
        columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
        return Places(*columns)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these numbers among their lengths."""
        key = self.length << 48 | self.first
        at = np.searchsorted(key, length << 48 | number, side="right") - 1
        inside = number - self.first[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


# --- the operator -----------------------------------------------------------------------------------


def pack(docs: DataFrame, name: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """One row per piece of a document; only the histogram of lengths reaches the driver."""
    pieces = measured(docs, name, length)
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(length + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    places = Places.of(plan(histogram))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(offsets, ["part", "length"]).select(*_NAMES[:5], (F.col("before") + F.col("nth")).alias("number"))

    def placed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = places.find(lengths, numbers)
            arrays = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*_NAMES[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(
        placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
