"""Byte strings that repeat across documents, from sparse suffix arrays.

Every window of 50 bytes picks an anchor by its content alone, the 16-byte string of smallest hash in it, so
equal windows pick equal anchors. Blocks of documents first exchange anchor hashes; anchors that one document
alone has are dropped. The rest are dealt by hash to fragments together with the bytes around them that any
window picking them can reach. There the suffixes that begin at the anchors are sorted into an array with the
lengths of their common prefixes, a stack scan walks the tree of its intervals, and within an interval the
strings to the left are scanned the same way: where they begin to differ, the repeat is maximal to the left.
Each maximal repeat comes with all its contexts; what a block sends is one row per distinct context with its
smallest document, however many copies there are.

A null text counts as empty; texts under 50 bytes lose nothing. A null id counts as larger than all others.
Rows that repeat an id are one document and do not take from each other. An empty table gives an empty result.
Only ``doc_id`` and ``text`` are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fenceline.llm import blocks, common
from fenceline.sources.shared import materialize

#: Bytes of a repeat at least, and of an anchor.
LENGTH, ANCHOR = 50, 16
GRAMS = LENGTH - ANCHOR + 1
LEFT, RIGHT = LENGTH - ANCHOR, LENGTH
#: Contexts sorted at once.
SHARE = 30_000
#: Text bytes behind one fragment, handled at once, and in one block.
FRAGMENT, PASS, BLOCK = 12_000_000, 250_000, 4_000_000
_LAST = np.iinfo(np.int64).max


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a, size = pick(a[: len(a) - size], a[size:]), 2 * size
    rest = width - size
    return pick(a[: len(a) - rest], a[rest:]) if rest else a


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of texts that begin at ``starts`` in ``raw``, and their hashes."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray(n - 7, dtype="<u8", buffer=raw, strides=(1,))
    h = words[: n - ANCHOR + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(order, GRAMS, np.minimum)
    # Windows that reach into the next text pick nothing.
    crossing = np.zeros(n + 1, dtype=np.int32)
    ends = np.append(starts[1:], n)
    np.add.at(crossing, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(crossing, ends, -1)
    least[np.cumsum(crossing[:-1])[: len(least)] > 0] = 0
    padded = np.concatenate((np.zeros(GRAMS - 1, np.uint32), least, np.zeros(GRAMS - 1, np.uint32)))
    at = np.flatnonzero(_slide(padded, GRAMS, np.maximum) == order)
    return at, h[at]


def _runs(ids: list, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in runs of about PASS bytes: index of the first, ids, bytes, and where each text begins."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= PASS):
            size += len(texts[last])
            last += 1
        own = np.array([_LAST if i is None else i for i in ids[first:last]], dtype=np.int64)
        starts = np.cumsum([0] + [len(t) for t in texts[first:last]])[:-1]
        yield first, own, np.frombuffer(b"".join(texts[first:last]), np.uint8), starts
        first = last


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _fragment(short: np.ndarray, n: int) -> np.ndarray:
    """Anchors are the smallest hashes of their windows, so they are mixed again before they are dealt."""
    return ((common.finish(short) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _send_anchors(n: int):
    """A block's distinct anchors by fragment, with a mark on those that several of its documents have."""

    def run(row):
        ids, texts = blocks.thaw(row["payload"])
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, own, raw, starts in _runs(ids, texts):
            at, h = anchors(raw, starts)
            found[0].append(_short(h))
            found[1].append(own[np.searchsorted(starts, at, "right") - 1])
        short, owner = map(np.concatenate, found)
        order, begins, _ = common.grouped(short)
        values, owner = short[order[begins]], owner[order]
        several = np.zeros(0, bool)
        if len(values):
            several = np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)
        fragment = _fragment(values, n)
        dealt = np.argsort(fragment, kind="stable")
        edges = np.searchsorted(fragment[dealt], np.arange(n + 1))
        for f in range(n):
            part = dealt[edges[f] : edges[f + 1]]
            if len(part):
                steps = np.diff(values[part], prepend=np.uint64(0))
                small = steps.astype(np.uint32) if steps[1:].max(initial=0) < 2**32 else steps
                small = (steps[0], small[1:]) if len(steps) else (np.uint64(0), small)
                yield f, row["block"], blocks.freeze((*small, np.packbits(several[part])))

    return run


def _unpack_anchors(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, several = blocks.thaw(payload)
    values = np.cumsum(np.concatenate(([first], steps.astype(np.uint64))), dtype=np.uint64)
    return values, np.unpackbits(several, count=len(values)).astype(bool)


def _shared_anchors(key, table):
    """The anchors of a fragment that several documents have, for each block that sent them."""
    sent = [_unpack_anchors(p.as_py()) for p in table.column("part")]
    order, begins, number = common.grouped(np.concatenate([v for v, _ in sent]))
    several = np.concatenate([s for _, s in sent])[order]
    shared = (np.diff(begins, append=len(order)) > 1) | np.maximum.reduceat(several, begins)
    rows, at = [], 0
    for block, (v, _) in zip(table.column("block").to_pylist(), sent):
        own = v[shared[number[at : at + len(v)]]]
        at += len(v)
        if len(own):
            rows.append((block, -1, blocks.freeze(own)))
    return blocks.batch_of(_TO_BLOCK, [list(c) for c in zip(*rows)] if rows else [[], [], []])


_TO_BLOCK = "block long, fragment long, part binary"
_TO_FRAGMENT = "fragment long, block long, part binary"


class _Contexts:
    """The distinct contexts of a block's shared anchors, and where they stand."""

    def __init__(self, ids: list, texts: list[bytes], shared: np.ndarray):
        text, position, owner, short, matrix, left, right = ([] for _ in range(7))
        for first, own, raw, starts in _runs(ids, texts):
            at, h = anchors(raw, starts)
            h = _short(h)
            if len(shared):
                near = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                keep = shared[near] == h
                at, h = at[keep], h[keep]
            else:
                at, h = at[:0], h[:0]
            k = np.searchsorted(starts, at, "right") - 1
            begin, end = starts[k], np.append(starts[1:], len(raw))[k]
            before, after = np.minimum(LEFT, at - begin), np.minimum(RIGHT, end - at)
            padded = np.concatenate((np.zeros(LEFT, np.uint8), raw, np.zeros(RIGHT, np.uint8)))
            rows = np.lib.stride_tricks.sliding_window_view(padded, LEFT + RIGHT)[at]
            # Bytes of neighbouring texts do not belong to a context.
            place = np.arange(LEFT + RIGHT, dtype=np.int16)
            rows *= place >= (LEFT - before).astype(np.int16)[:, None]
            rows *= place < (LEFT + after).astype(np.int16)[:, None]
            matrix.append(rows)
            text.append(first + k)
            position.append(at - begin)
            owner.append(own[k])
            short.append(h)
            left.append(before)
            right.append(after)
        if not text:
            text = position = owner = left = right = [np.zeros(0, np.int64)]
            short, matrix = [np.zeros(0, np.uint64)], [np.zeros((0, LEFT + RIGHT), np.uint8)]
        self.text, self.position, owner = np.concatenate(text), np.concatenate(position), np.concatenate(owner)
        self.owner, self.left, self.right = owner, np.concatenate(left), np.concatenate(right)
        matrix, short = np.concatenate(matrix), np.concatenate(short)
        wide = np.zeros((len(matrix), 88), np.uint8)
        wide[:, : LEFT + RIGHT] = matrix
        wide[:, 84], wide[:, 85] = self.left, self.right
        h = np.zeros(len(matrix), np.uint64)
        for column in wide.view("<u8").T:
            h = common.finish(h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        order, begins, self.number = common.grouped(h)
        first = order[begins]
        self.least = np.minimum.reduceat(owner[order], begins) if len(begins) else owner
        self.matrix, self.short = matrix[first], short[first]
        self.lengths = np.stack((self.left[first], self.right[first]), 1).astype(np.uint8)


def _shared_of(parts: dict) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *[blocks.thaw(p) for f, p in parts if f < 0]]))


def _parts(table) -> list[tuple[int, bytes]]:
    return list(zip(table.column("fragment").to_pylist(), table.column("part").to_pylist()))


def _send_contexts(n: int):
    def run(key, block, shared):
        if not block.num_rows:
            return blocks.batch_of(_TO_FRAGMENT, [[], [], []])
        ids, texts = blocks.thaw(block.column("payload")[0].as_py())
        found = _Contexts(ids, texts, _shared_of(_parts(shared)))
        fragment = _fragment(found.short, n)
        rows = []
        for f in np.unique(fragment):
            own = np.flatnonzero(fragment == f)
            rows.append((int(f), key[0].as_py(), blocks.freeze((found.matrix[own], found.lengths[own], found.least[own]))))
        return blocks.batch_of(_TO_FRAGMENT, [list(c) for c in zip(*rows)] if rows else [[], [], []])

    return run


def intervals(common_prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of a sorted array in which neighbours i and i + 1 share
    ``common_prefix[i]``: all maximal runs with a common prefix of ``depth``, at least ``least``, children
    before parents, by a scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*common_prefix, -1]):
        begin = i
        while stack and stack[-1][0] > depth:
            top, begin = stack.pop()
            if top >= least:
                yield top, begin, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, begin))


def _shared_prefixes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the next one, no more than either has."""
    same = rows[1:] == rows[:-1]
    run = np.where(same.all(1), rows.shape[1], np.argmin(same, 1)) if len(same) else np.zeros(0, np.int64)
    return np.minimum(run, np.minimum(lengths[1:], lengths[:-1]))


def maximal_repeats(
    left: np.ndarray, left_lengths: np.ndarray, right: np.ndarray, right_lengths: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes to the left, bytes to the right, contexts) of every maximal repeat of LENGTH bytes or more in
    distinct contexts sorted by their right side. ``left`` has the bytes before the anchor, nearest first."""
    shared = _shared_prefixes(right, right_lengths)
    run_edges = np.flatnonzero(shared < ANCHOR) + 1
    begins, ends = np.append(0, run_edges), np.append(run_edges, len(right))
    for begin, end in zip(begins, ends):
        if end - begin < 2:
            continue
        for depth, first, last in intervals(shared[begin : end - 1].tolist(), ANCHOR):
            members = np.arange(begin + first, begin + last + 1)
            need = LENGTH - depth
            lefts = left[members]
            order = np.lexsort(lefts.T[::-1])
            members, lefts = members[order], lefts[order]
            before = _shared_prefixes(lefts, left_lengths[members])
            if (before < max(need, 0)).all():
                continue
            for more, a, b in intervals(before.tolist(), max(need, 0)):
                # The scan yields runs whose left sides differ beyond `more`: maximal to the left.
                yield more, depth, members[a : b + 1]


def _find_repeats(key, table):
    """Per block and context: its smallest document anywhere, and how far to the left and right of the anchor
    it repeats a context whose smallest document is smaller still."""
    sent = [blocks.thaw(p.as_py()) for p in table.column("part")]
    counts = [len(x) for _, _, x in sent]
    matrix, lengths, least = (np.concatenate(c) for c in zip(*sent))
    del sent
    smallest, reach = np.empty(len(matrix), np.int64), np.zeros((len(matrix), 2), np.uint8)
    # Contexts of one anchor are in one share; shares are small whatever a fragment has gathered.
    share = common.finish(np.ascontiguousarray(matrix[:, LEFT : LEFT + 8]).view("<u8")[:, 0])
    share %= np.uint64(1 + len(matrix) // SHARE)
    order = np.argsort(share, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(share[order])) + 1):
        smallest[own], reach[own] = _repeats_of(matrix[own], lengths[own], least[own])
    rows, at = [], 0
    for block, n in zip(table.column("block").to_pylist(), counts):
        rows.append((block, key[0].as_py(), blocks.freeze((smallest[at : at + n], reach[at : at + n]))))
        at += n
    return blocks.batch_of(_TO_BLOCK, [list(c) for c in zip(*rows)])


def _repeats_of(matrix: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: its smallest document, and how far it repeats one of a smaller document."""
    left, right = matrix[:, :LEFT][:, ::-1], matrix[:, LEFT:]
    wide = np.zeros((len(matrix), 104), np.uint8)
    wide[:, :RIGHT], wide[:, 56 : 56 + LEFT], wide[:, 96:98] = right, left, lengths
    order = np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])
    wide = wide[order]
    new = np.concatenate(([True], (wide[1:] != wide[:-1]).any(1)))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    reach = np.zeros((len(first), 2), np.uint8)
    sides = left[first], lengths[first, 0].astype(int), right[first], lengths[first, 1].astype(int)
    for more, depth, members in maximal_repeats(*sides):
        behind = members[smallest[members] > smallest[members].min()]
        reach[behind] = np.maximum(reach[behind], (more, depth))
    return smallest[number], reach[number]


def _spans(ids: list, texts: list[bytes], parts: list[tuple[int, bytes]], n: int) -> list[list[tuple[int, int]]]:
    """The maximal runs to remove from each text."""
    found = _Contexts(ids, texts, _shared_of(parts))
    fragment = _fragment(found.short, n)
    smallest, reach = np.full(len(fragment), _LAST), np.zeros((len(fragment), 2), np.int64)
    for f, part in parts:
        if f >= 0:
            own = np.flatnonzero(fragment == f)
            smallest[own], reach[own] = blocks.thaw(part)
    behind = (found.owner > smallest[found.number]) & (found.left + found.right >= LENGTH)
    left = np.where(behind, found.left, reach[found.number, 0])
    right = np.where(behind, found.right, reach[found.number, 1])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    real = np.flatnonzero(left + right >= LENGTH)
    begin, end, text = found.position[real] - left[real], found.position[real] + right[real], found.text[real]
    for i in np.lexsort((begin, text)):
        runs, a, b = out[text[i]], int(begin[i]), int(end[i])
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return out


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[e for run in runs for e in run], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def removed(packed: DataFrame, size: int, result, schema: str | StructType) -> DataFrame:
    """``result(block row, ids, texts, spans)``, a table under ``schema``, for every block of ``packed``, ``size`` bytes of
    text in all; the spans of a text are the maximal runs of bytes that lie in a LENGTH-byte string which also starts in
    a smaller document."""
    n = max(1, -(-size // FRAGMENT))
    texts_only = packed.select("block", "payload")
    sent = texts_only.mapInArrow(blocks.per_row(_send_anchors(n), _TO_FRAGMENT), _TO_FRAGMENT)
    shared = materialize(sent.groupBy("fragment").applyInArrow(_shared_anchors, _TO_BLOCK), "anchors")
    contexts = texts_only.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_contexts(n), _TO_FRAGMENT)
    found = contexts.groupBy("fragment").applyInArrow(_find_repeats, _TO_BLOCK)

    def cut(key, block, parts):
        if not block.num_rows:
            return result(None, [], [], [])
        ids, texts = blocks.thaw(block.column("payload")[0].as_py())
        return result(block, ids, texts, _spans(ids, texts, _parts(parts), n))

    answers = shared.unionByName(found)
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


_REMOVALS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""

    def digest(doc_id, text, runs):
        taken = sum(b - a for a, b in runs)
        return doc_id, len(text), taken, len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()

    def result(block, ids, texts, spans):
        rows = [digest(*row) for row in zip(ids, texts, spans)]
        return blocks.batch_of(_REMOVALS, [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)])

    return removed(blocks.pack(docs, BLOCK), common.text_bytes(docs), result, _REMOVALS)


def _pack_rows(docs: DataFrame) -> DataFrame:
    """Blocks of texts together with the other columns of their rows, as they are."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    columns = [F.col("doc_id").cast("long").alias("key"), F.col("text").cast("binary").alias("bytes"), others.alias("rest")]

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, rests, held = [], [], [], 0

        def out():
            rest, sink = pa.chunked_array(rests), pa.BufferOutputStream()
            empty = pa.array([t is None for t in texts])
            table = pa.table({"rest": rest, "none": empty})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            payload = blocks.freeze((ids, [t or b"" for t in texts]))
            arrays = [pa.array([block]), pa.array([payload], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["block", "payload", "rows"])

        for batch in batches:
            begin = 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                t = t.as_buffer().to_pybytes() if t.is_valid else None
                if ids and held + len(t or b"") > BLOCK:
                    if k > begin:
                        rests.append(batch.column(2).slice(begin, k - begin))
                    yield out()
                    block, ids, texts, rests, held, begin = block + 1, [], [], [], 0, k
                ids.append(i)
                texts.append(t)
                held += len(t or b"")
            if batch.num_rows > begin:
                rests.append(batch.column(2).slice(begin))
        if ids:
            yield out()

    return materialize(docs.select(*columns).mapInArrow(run, "block long, payload binary, rows binary"), "blocks")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the remaining text, in which a character that lost part of its bytes is left
    out, and ``n_chars`` to match if there is one. Other columns, and texts that lose nothing, stay as they are.

    Blocks carry whole rows, so the last pass gives finished rows and nothing is joined afterwards."""
    names, n_chars = docs.columns, dict(docs.dtypes).get("n_chars")
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "double": pa.float64(), "string": pa.string()}

    def result(block, ids, texts, spans):
        if block is None:
            return to_arrow_schema(docs_schema).empty_table()
        table = pa.ipc.open_stream(block.column("rows")[0].as_buffer()).read_all()
        rest, none = table.column("rest").combine_chunks(), table.column("none").to_pylist()
        kept = [None if gone else _kept(t, runs).decode(errors="ignore") for t, runs, gone in zip(texts, spans, none)]
        columns = dict(zip([c for c in names if c != "text"], rest.flatten())) | {"text": pa.array(kept, pa.string())}
        if n_chars in arrow:
            sizes = pa.array([None if t is None else len(t) for t in kept], pa.int64())
            columns["n_chars"] = sizes.cast(arrow[n_chars])
        return pa.table([columns[c] for c in names], names)

    docs_schema = docs.schema
    return removed(_pack_rows(docs), common.text_bytes(docs), result, docs_schema)
