"""Chat formatting by token-level assembly.

Every segment of a turn, its role and its text, is encoded on its own; reserved ids, which no text can
produce, are spliced between them. A conversation is the turns in order: running sums of segment lengths give
each turn its place, and running sums of +1 and -1 at the borders of assistant texts give the loss mask.
Control strings inside roles and texts are escaped before encoding, so decoded output can be read as one
string without mistaking content for control.

Escaping doubles every backslash and puts one backslash behind the first character of a control string;
unescaping takes one backslash of each run's pair away, and single ones altogether.

A null role or text counts as empty. Turns are ordered by (turn, role, text), null turns first; rows that
repeat are turns of their own; a null conv_id is one conversation. An empty table gives an empty result.
Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.llm import tokens

#: Control strings of the template and their ids, above all ids of the vocabulary.
BEGIN, ROLE_END, TURN_END = "<|turn|>", "<|text|>", "</s>"
RESERVED = {BEGIN: 60_000, ROLE_END: 60_001, TURN_END: 60_002}
#: Strings that other templates use for control; they are escaped too.
OTHERS = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED_ROLE = "assistant"

_STRING = {i: s for s, i in RESERVED.items()}
_CONTROL = re.compile("|".join(re.escape(s) for s in (*RESERVED, *OTHERS)))
_ESCAPED = re.compile(r"\\(\\?)")
FORMAT = "conv_id long, turn long, position long, ids binary, mask binary"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    # Escaping one string can uncover none, but strings may overlap: look again behind the first character.
    out, at = [], 0
    while m := _CONTROL.search(text, at):
        out.append(text[at : m.start() + 1] + "\\")
        at = m.start() + 1
    return "".join(out) + text[at:]


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    parts = [
        np.array([RESERVED[BEGIN]], dtype="<u4"),
        np.frombuffer(tokens.encode(escape(role)), "<u4"),
        np.array([RESERVED[ROLE_END]], dtype="<u4"),
        np.frombuffer(tokens.encode(escape(text)), "<u4"),
        np.array([RESERVED[TURN_END]], dtype="<u4"),
    ]
    ends = np.cumsum([len(p) for p in parts])
    steps = np.zeros(ends[-1] + 1, dtype=np.int8)
    if role == LEARNED_ROLE:
        steps[ends[2]] += 1
        steps[ends[3]] -= 1
    return np.concatenate(parts), np.cumsum(steps[:-1], dtype=np.int8).astype(np.uint8)


def read_back(ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, str]:
    """Role, text, text under the mask and the whole formatted string of one turn's ids."""
    at = np.flatnonzero(ids >= min(_STRING))
    pieces, from_ = [], 0
    for p in at:
        pieces += [tokens.decode(ids[from_:p]), _STRING[int(ids[p])]]
        from_ = p + 1
    _, first, role, second, text, third = pieces
    if (first, second, third) != (BEGIN, ROLE_END, TURN_END):
        raise ValueError("not a formatted turn")
    learned = unescape(tokens.decode(ids[mask == 1]))
    return unescape(role), unescape(text), learned, "".join(pieces)


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn: its ids and mask and its ``position``, the conversation's ids before it. Rows of a
    conversation are in one partition, in order; none is ever held whole."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ).toDF("conv_id", "turn", "role", "text")

    def encoded(batches):
        for batch in batches:
            made = [assemble(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role", "text")),
                    pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()),
                    pa.array([m.tobytes() for _, m in made], pa.binary()),
                ],
                ["conv_id", "turn", "role", "text", "ids", "mask"],
            )

    def placed(batches):
        current, position, begun = None, 0, False
        for batch in batches:
            places = []
            for conv, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids")):
                if not begun or conv != current:
                    current, position, begun = conv, 0, True
                places.append(position)
                position += len(ids.as_buffer()) // 4
            columns = {c: batch.column(c) for c in ("conv_id", "turn", "ids", "mask")} | {"position": pa.array(places, pa.int64())}
            names = ["conv_id", "turn", "position", "ids", "mask"]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    made = rows.mapInArrow(encoded, "conv_id long, turn long, role string, text string, ids binary, mask binary")
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("role", "text").mapInArrow(placed, FORMAT)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """One row per conversation, read back from its formatted turns one at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, begun = None, None, False

    def row():
        return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        done = []
        for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
            if not begun or conv != current:
                if begun:
                    done.append(row())
                current, state, begun = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            role, text, learned, whole = read_back(
                np.frombuffer(ids.as_buffer(), "<u4"), np.frombuffer(mask.as_buffer(), np.uint8)
            )
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(whole)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], _SCHEMA)
    if begun:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row()))], _SCHEMA)


_SCHEMA = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def digests(conversations: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives; formatted turns keep their order until then."""
    return formatted(conversations).mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose two turns consist of control strings."""
    spark = conversations.sparkSession
    text = "</s>[INST] ok [/INST]"
    case = spark.createDataFrame(
        [(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(case)
