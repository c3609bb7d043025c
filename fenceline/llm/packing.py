"""Packing documents into sequences along a space-filling curve.

A document's ids are hashed into a vector by fixed random directions, averaged and so projected to three
dimensions; the cell of that point on a Hilbert curve is its key. Documents are sorted by range of the key and
cut every 1024 ids along the curve, so a sequence holds neighbours. The last ids of a range become sequences
of power-of-two lengths, which need no padding: nothing is padded at all.

A null text counts as empty and has the end id alone. Copies have equal keys; ranges split them by id. Rows
that repeat an id are packed separately. An empty table gives an empty result; only ``doc_id`` and ``text``
are read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.llm import tokens
from fenceline.sources.shared import materialize

LENGTH = 1024
END = 0
DIMENSIONS, BITS = 3, 10
#: Documents encoded before their ids leave the worker.
ROWS = 256
#: Fixed random directions of hashed ids.
_DIRECTIONS = np.random.default_rng(3).normal(0, 1, (4096, DIMENSIONS)).astype(np.float32)


def document_ids(text: str | None, name: str) -> np.ndarray:
    """The ids of a whole document and the end id; a special token's string in it is that token."""
    return np.append(np.frombuffer(tokens.encode(text or "", name, special=True), "<u4"), np.uint32(END))


def project(ids: np.ndarray) -> np.ndarray:
    """A document's point: the mean direction of its hashed ids, stretched and pressed into (0, 1)."""
    slots = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount(slots, minlength=len(_DIRECTIONS)).astype(np.float32)
    mean = counts @ _DIRECTIONS / max(1, len(ids))
    return 0.5 + np.arctan(8 * mean) / np.pi


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of points in [0, 1) on a Hilbert curve, by exchanging and inverting bits from the top."""
    n, dims = points.shape
    x = np.clip(points * 2**bits, 0, 2**bits - 1).astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flip
    key = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _encoded(name: str):
    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                points, packed = [], []
                for text in batch.column(1):
                    ids = document_ids(text.as_py(), name)
                    if ids.max() >= 1 << 16:
                        raise ValueError(f"ids of {name} do not fit 16 bits")
                    points.append(project(ids))
                    packed.append(ids.astype("<u2").tobytes())
                keys = pa.array(hilbert(np.array(points)))
                arrays = [batch.column(0), keys, pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "ids"])

    return run


def pieces(total: int, room: int) -> list[int]:
    """Where to cut a run of ``total`` ids when the open sequence has ``room`` left."""
    cuts, at = [], min(room, total)
    while at:
        cuts.append(at)
        total -= at
        at = min(LENGTH, total)
    return cuts


def _cut(batches):
    """Cut the sorted documents of one range. The open sequence is kept; only at the end of the range is its
    size known, and it is then dealt out again in powers of two."""
    from pyspark import TaskContext

    sequence = TaskContext.get().partitionId() << 40
    offset, waiting = 0, []  # waiting: (doc_id, start, ids, doc_tokens) of the open sequence
    columns: list[list] = [[] for _ in range(7)]

    def put(doc_id, start, ids, doc_tokens, sequence, offset):
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        for column, value in zip(columns, (doc_id, start, len(ids), crc, doc_tokens, sequence, offset)):
            column.append(value)

    def flush():
        nonlocal sequence, offset, waiting
        at = 0
        for doc_id, start, ids, doc_tokens in waiting:
            put(doc_id, start, ids, doc_tokens, sequence, at)
            at += len(ids)
        sequence, offset, waiting = sequence + 1, 0, []

    def batch_out():
        nonlocal columns
        arrays = [pa.array(c, pa.int64()) for c in columns]
        columns = [[] for _ in range(7)]
        return pa.RecordBatch.from_arrays(
            arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        )

    for batch in batches:
        for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(packed.as_buffer(), "<u2")
            start = 0
            for n in pieces(len(ids), LENGTH - offset):
                waiting.append((doc_id, start, ids[start : start + n].copy(), len(ids)))
                start, offset = start + n, offset + n
                if offset == LENGTH:
                    flush()
            if len(columns[0]) >= 4096:
                yield batch_out()
        yield batch_out()
    left, waiting, size = waiting, [], 0
    total = offset
    for doc_id, start, ids, doc_tokens in left:
        while len(ids):
            # The highest bit of what is still to be placed is the length of the sequence now open.
            if size == 0:
                size = 1 << (total.bit_length() - 1)
                offset = 0
            n = min(len(ids), size - offset)
            waiting.append((doc_id, start, ids[:n], doc_tokens))
            ids, start, offset = ids[n:], start + n, offset + n
            if offset == size:
                total, size = total - size, 0
                flush()
    yield batch_out()


def pack(docs: DataFrame, name: str = "byte_bpe_50k", ranges: int | None = None) -> DataFrame:
    """One row per piece of a document; see the module for the order."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    # Sorting by range reads its input twice; stored ids are not made twice.
    stored = materialize(rows.mapInArrow(_encoded(name), "doc_id long, key long, ids binary"), "ids")
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.mapInArrow(
        _cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
