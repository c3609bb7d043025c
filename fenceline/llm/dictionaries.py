"""Quality scores from compression with two dictionaries.

One zstandard dictionary is built from text labelled good, one from text labelled bad. A text is compressed
in short pieces with both; the difference of the two sizes by their sum says which dictionary knows its
pieces better, and a logistic curve fitted on labelled rows that the dictionaries have not seen turns it into
a probability. A word that its next word repeats is written as one mark byte first, so that repetition is
something a dictionary can know.

Null and empty texts have no difference and get the score of 0. Rows are scored one by one: repeated rows
get equal scores and an empty table an empty result. Only ``doc_id`` and ``text`` are read of documents.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.llm import common

#: Labelled rows per label that teach the model, and the largest text among them in bytes.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 65_536
#: Random 1 KB pieces of the sample that train each dictionary; text of the sample beyond them is left out.
SAMPLE_PIECES = 6000
PIECE = 256
DICTIONARY = 131_072
LEVEL = 3

_REPEATED = re.compile(rb"(?<!\S)(\S+)(?=\s\1(?!\S))")
_ready: dict = {}


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.slope * differences(texts, self.good, self.bad) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def marked(text: bytes) -> bytes:
    return _REPEATED.sub(b"\x01", text)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _ready:
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        # Raw content serves where there was too little text to train a dictionary.
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        prepared = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        prepared.precompute_compress(compression_params=options)
        _ready[dictionary] = zstandard.ZstdCompressor(dict_data=prepared, compression_params=options)
    return _ready[dictionary]


def differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(bad - good) / (bad + good) of the compressed sizes: above 0 where the good dictionary fits better."""
    by_good, by_bad = _compressor(good), _compressor(bad)
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        text = marked(text)
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        g = sum(len(by_good.compress(p)) for p in pieces)
        b = sum(len(by_bad.compress(p)) for p in pieces)
        out[k] = (b - g) / max(1, b + g)
    return out


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + 1024] for t in map(marked, texts) for i in range(0, len(t), 1024)]
    order = np.random.default_rng(0).permutation(len(pieces))[:SAMPLE_PIECES]
    pieces = [pieces[i] for i in order]
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(max(size, 256), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few pieces
        return b"".join(pieces)[:DICTIONARY] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, lightly held to 0."""
    scale = x.std() or 1.0
    a = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        w -= np.linalg.solve(hessian, a.T @ (p - y) + 0.1 * w)
    return float(w[0] / scale), float(w[1])


def train(texts: list[bytes], good: list[int], share: float | None = None) -> Model:
    """Dictionaries from the even rows of each label, the curve from the odd ones.

    ``share`` is that of good rows where the texts come from, if theirs is another."""
    y = np.array(good, dtype=float)
    for_dictionary = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        for_dictionary[np.flatnonzero(y == label)[::2]] = True
    by_good = _dictionary([t for t, d, q in zip(texts, for_dictionary, y) if d and q == 1])
    by_bad = _dictionary([t for t, d, q in zip(texts, for_dictionary, y) if d and q == 0])
    rest = [t for t, d in zip(texts, for_dictionary) if not d]
    if not rest:
        return Model(by_good, by_bad, 0.0, 0.0)
    slope, offset = _logistic(differences(rest, by_good, by_bad), y[~for_dictionary])
    seen = y[~for_dictionary].mean()
    if share is not None and 0 < seen < 1 and 0 < share < 1:
        offset += float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return Model(by_good, by_bad, slope, offset)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int], float | None]:
    """At most SAMPLE_ROWS texts of each label from the training rows, in the order of the id's hash, their
    labels, and the share of good rows among all training rows."""
    training = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(common.remainder(F.col("doc_id"), 4) != 2)
    one = training.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    texts, marks = [], []
    for label in (0, 1):
        chosen = one.where(F.col("_quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
        rows = rows.join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_ROWS small rows
        found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_ROWS).collect()
        texts += [r["text"].encode() for r in found]
        marks += [label] * len(found)
    return texts, marks, one.agg(F.avg("_quality")).first()[0]


def quality_scores(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    model = train(*labelled_sample(docs, labels))

    def score(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            scores = model.score(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(common.held_out_rows(ids, 4, 2)),
                    pa.array(scores),
                    pa.array((scores >= at).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
