"""Documents packed into compressed blocks.

A block is one row that holds about ``BLOCK`` bytes of text. Operators that pass over all texts more than once,
and exchange only digests between the passes, store the blocks once and join digests to whole blocks.
"""

import pickle
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize

BLOCK = 12_000_000
SCHEMA = "block long, payload binary"
_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "string": pa.string(),
}


def freeze(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def thaw(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def pack(docs: DataFrame, size: int = BLOCK, label: str = "blocks") -> DataFrame:
    """A stored table of blocks; ``thaw`` of a payload gives (ids, texts as UTF-8). Null texts count as empty."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([freeze((ids, texts))], pa.binary())], ["block", "payload"]
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_buffer().to_pybytes() if t.is_valid else b""
                if ids and held + len(t) > size:
                    yield out()
                    block, ids, texts, held = block + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return materialize(rows.mapInArrow(run, SCHEMA), label)


def per_row(function, schema: str):
    """``function(row as dict) -> iterator of tuples`` over all rows, one at a time, for ``mapInArrow``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                yield from chunks(function(row), names)

    return run


def chunks(rows, names: list[str], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches; binaries end a batch early."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= most or weight > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names)


def batch_of(schema: str, columns: list) -> pa.Table:
    """A table of the given columns under a Spark schema string."""
    fields = [c.split() for c in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])
