"""Toxicity by a small convolutional text classifier, trained in numpy.

Words become 32-bit hashes; those that several training texts contain have an embedding, all others share
one of zeros. Filters of several widths slide over the words of a text, each gives the maximum over the whole
text, and a logistic unit weighs the maxima. Training follows the gradient through the words at which each
maximum stands. The language is guessed from function words of the text itself, and every language has its
own threshold, set on rows the network has not trained on; scores are shifted so that the threshold is 0.7.

Null and empty texts score what a text without known words scores. Rows are scored one by one: repeated rows
get equal scores and an empty table an empty result. Only ``doc_id`` and ``text`` are read of documents.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.llm import common

#: Labelled rows per label that teach the model, and the largest text among them in bytes.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 65_536
WIDTHS = (1, 2, 3)
FILTERS = 6
DIMENSIONS = 12
#: Training texts that must contain a word before it has an embedding of its own.
SEEN = 3
EPOCHS = 5
BATCH = 64
AT = 0.7
#: Function words by which a language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on was with as be by this from are",
    "de": "der die das und ist von mit den dem ein eine im zu auf nicht sich",
    "fr": "le les des et est une en que qui dans pour sur du par avec un",
    "es": "el los las del y una por con no se su para es al lo como",
}
LANGUAGES = tuple(FUNCTION_WORDS)

_SEPARATORS = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + b"[\\]^_`{|}~", b" " * 32)


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit word hashes of all texts, with an empty word (0) after each text, and where each text begins."""
    h, bounds = common.word_hashes([t.translate(_SEPARATORS) for t in texts])
    h = (h >> np.uint64(32)).astype(np.uint32)
    return np.insert(h, bounds[1:], 0), bounds + np.arange(len(bounds))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``hashes`` of many texts in parts, for bounded memory."""
    parts, bounds = [], [np.zeros(1, dtype=np.int64)]
    for _, some in common.blocks(texts, texts, 500_000, encoded=True):
        h, b = hashes(some)
        parts.append(h)
        bounds.append(b[1:] + bounds[-1][-1])
    return np.concatenate(parts), np.concatenate(bounds)


@dataclass
class Model:
    known: np.ndarray  # sorted hashes; entry 0 is the hash of no word
    embeddings: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dimensions, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: float
    language: np.ndarray  # (known, languages): 1 where a word speaks for a language
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))
    slope: float = 1.0

    def words(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == h, at, 0)

    def maxima(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(texts, all filters) and, by width, the response at every word. A window may reach into the
        empty words after a text."""
        found, responses = [], []
        for w, b in zip(self.filters, self.biases):
            r = (self.embeddings @ w[0])[words]
            for t in range(1, len(w)):
                shifted = (self.embeddings @ w[t])[words[t:]]
                shifted[_crosses(bounds, t, len(words))] = 0
                r[: len(words) - t] += shifted
            r += b
            responses.append(r)
            found.append(np.maximum.reduceat(r, bounds[:-1], axis=0))
        return np.hstack(found), responses

    def spoken(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        votes = np.add.reduceat(self.language[words], bounds[:-1], axis=0)
        return np.where(votes.max(1) > 0, votes.argmax(1), len(LANGUAGES))

    def raw(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.tanh(self.maxima(words, bounds)[0]) @ self.weights + self.offset

    def score(self, texts: list[bytes]) -> np.ndarray:
        h, bounds = hashes(texts)
        words = self.words(h)
        z = self.slope * (self.raw(words, bounds) - self.thresholds[self.spoken(words, bounds)])
        return 1 / (1 + np.exp(-np.clip(z + np.log(AT / (1 - AT)), -40, 40)))


def _crosses(bounds: np.ndarray, t: int, n: int) -> np.ndarray:
    """Positions p < n - t for which p + t lies in a later text than p."""
    at = (bounds[1:-1, None] - np.arange(1, t + 1)).ravel()
    return at[(at >= 0) & (at < n - t)]


def _start(h: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rng) -> Model:
    """Embeddings begin with the log odds of a word among toxic texts, the rest is small noise."""
    pairs = np.concatenate(
        [np.unique(h[a:b]).astype(np.uint64) | np.uint64(i << 32) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    )
    word, label = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), toxic[(pairs >> np.uint64(32)).astype(np.int64)]
    known, inverse, count = np.unique(word, return_inverse=True, return_counts=True)
    bad = np.bincount(inverse, weights=label, minlength=len(known))
    language_hashes = [hashes([words.encode()])[0] for words in FUNCTION_WORDS.values()]
    keep = (count >= SEEN) | np.isin(known, np.concatenate(language_hashes)) | (known == 0)
    known, count, bad = known[keep], count[keep], bad[keep]
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((count - bad + 0.5) / ((1 - toxic).sum() + 1))
    embeddings = rng.normal(0, 0.05, (len(known), DIMENSIONS))
    embeddings[:, 0] = odds / 4
    embeddings[known == 0] = 0
    filters = [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[0, 0] += 0.8
    weights = np.full(len(WIDTHS) * FILTERS, 0.3)
    language = np.stack([np.isin(known, x) & (known != 0) for x in language_hashes], 1).astype(np.float32)
    return Model(known, embeddings, filters, [np.zeros(FILTERS) for _ in WIDTHS], weights, -1.0, language)


class _Adam:
    """Step sizes by Adam for one array; ``rows`` limits a step to those rows."""

    def __init__(self, array: np.ndarray, rate: float):
        self.array, self.rate, self.m, self.v, self.n = array, rate, np.zeros_like(array), np.zeros_like(array), 0

    def step(self, gradient: np.ndarray, rows=slice(None)) -> None:
        self.n += 1
        self.m[rows] += 0.1 * (gradient - self.m[rows])
        self.v[rows] += 0.01 * (gradient**2 - self.v[rows])
        scale = np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        self.array[rows] -= self.rate * scale * self.m[rows] / (np.sqrt(self.v[rows]) + 1e-8)


def _fit(model: Model, words: list[np.ndarray], toxic: np.ndarray, rng) -> None:
    offset = np.array([model.offset])
    steps = [_Adam(a, 0.01) for a in (*model.filters, *model.biases, model.weights, offset)]
    embedding_step = _Adam(model.embeddings, 0.01)
    balance = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-6), 0.5 / max(1 - toxic.mean(), 1e-6))
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for first in range(0, len(order), BATCH):
            batch = order[first : first + BATCH]
            flat = np.concatenate([words[i] for i in batch])
            bounds = np.concatenate(([0], np.cumsum([len(words[i]) for i in batch])))
            top, responses = model.maxima(flat, bounds)
            pooled = np.tanh(top)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + offset[0], -30, 30)))
            error = (p - toxic[batch]) * balance[batch] / len(batch)
            back = np.outer(error, model.weights) * (1 - pooled**2)
            gradients, moved = [], np.zeros((0, DIMENSIONS))
            touched = np.zeros(0, dtype=np.int64)
            for k, w in enumerate(model.filters):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                g = np.zeros_like(w)
                owner = np.repeat(np.arange(len(batch)), np.diff(bounds))
                hit, column = np.nonzero(responses[k] == top[owner][:, part])
                # The first word at which the maximum stands.
                _, one = np.unique(owner[hit] * FILTERS + column, return_index=True)
                hit, column = hit[one], column[one]
                slope = back[:, part][owner[hit], column]
                for t in range(len(w)):
                    inside = hit + t < bounds[owner[hit] + 1]
                    at, c, s = flat[(hit + t)[inside]], column[inside], slope[inside]
                    np.add.at(g[t].T, c, s[:, None] * model.embeddings[at])
                    touched = np.concatenate((touched, at))
                    moved = np.vstack((moved, s[:, None] * w[t].T[c]))
                gradients.append(g + 1e-4 * w)
            gradients += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
            gradients += [pooled.T @ error + 1e-4 * model.weights, np.array([error.sum()])]
            for step, gradient in zip(steps, gradients):
                step.step(gradient)
            rows, inverse = np.unique(touched, return_inverse=True)
            total = np.zeros((len(rows), DIMENSIONS))
            np.add.at(total, inverse, moved)
            real = model.known[rows] != 0
            embedding_step.step(total[real], rows[real])
    model.offset = float(offset[0])


def _best_threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap at which most rows fall on their own side, errors on clean rows counting twice."""
    order = np.argsort(z)
    z, toxic = z[order], toxic[order]
    missed = np.concatenate(([0], np.cumsum(toxic)))
    wrong = 2 * (len(z) - toxic.sum() - np.concatenate(([0], np.cumsum(1 - toxic))))
    edges = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    cost = missed + wrong
    best = np.flatnonzero(cost == cost.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Three quarters of the rows train the network, the rest sets slope and thresholds."""
    rng = np.random.default_rng(11)
    toxic = np.array(labels, dtype=float)
    if not len(texts):
        texts, toxic = [b""], np.zeros(1)
    h, bounds = _hashed(texts)
    for_fit = np.arange(len(texts)) % 4 != 3
    chosen = np.repeat(for_fit, np.diff(bounds))
    model = _start(h[chosen], np.concatenate(([0], np.cumsum(np.diff(bounds)[for_fit]))), toxic[for_fit], rng)
    words = model.words(h)
    _fit(model, [words[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(for_fit)], toxic[for_fit], rng)
    z, spoken = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for first in range(0, len(texts), BATCH):
        own = bounds[first : first + BATCH + 1]
        part = words[own[0] : own[-1]]
        z[first : first + BATCH] = model.raw(part, own - own[0])
        spoken[first : first + BATCH] = model.spoken(part, own - own[0])
    held = ~for_fit
    if 0 < toxic[held].sum() < held.sum():
        everywhere = _best_threshold(z[held], toxic[held])
        for k in range(len(model.thresholds)):
            own = held & (spoken == k)
            enough = toxic[own].sum() >= 20 and (1 - toxic[own]).sum() >= 20
            model.thresholds[k] = _best_threshold(z[own], toxic[own]) if enough else everywhere
        gap = np.median(z[held & (toxic == 1)]) - np.median(z[held & (toxic == 0)])
        model.slope = float(6 / max(gap, 0.5))
    else:
        model.thresholds[:] = z.max() + 1
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """At most SAMPLE_ROWS texts of each label from the training rows, in the order of the id's hash."""
    training = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(common.remainder(F.col("doc_id"), 3) != 1)
    one = training.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    found = []
    for label in (0, 1):
        chosen = one.where(F.col("_toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES)
        rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("_at", F.xxhash64("doc_id"))  # SAMPLE_ROWS small rows
        found += rows.orderBy("_at", "doc_id", "text").limit(SAMPLE_ROWS).collect()
    found.sort(key=lambda r: (r["_at"], r["doc_id"]))
    return [r["text"].encode() for r in found], [r["_toxic"] for r in found]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(*labelled_sample(docs, labels))

    def score(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores = [model.score(texts) for _, texts in common.blocks(ids, batch.column(1).to_pylist(), 500_000)]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(common.held_out_rows(ids, 3, 1)),
                    pa.array(scores),
                    pa.array((scores >= AT).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
