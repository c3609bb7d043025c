"""Ranked lexical search: MaxScore with precomputed bounds for pairs of terms.

The index is a row per shard, some megabytes of text, with the postings of all its terms. Queries are taken in
blocks of a bounded number of terms. For a block the document frequencies are summed over all shards, weights
follow from them, and a second pass writes the block's lists: every posting's impact on a score, and for each
pair of terms that are neighbours in a query's order of weights the largest joint impact in the intersection of
their two lists.

A query takes its terms by weight. What documents can gain at most from its i lightest terms is the least sum
over all ways to cut these terms into single ones and neighbouring pairs, a pair counting with its joint maximum
(or the larger maximum of one alone) in place of the sum of both maxima. Terms are read from the heaviest down, and
as soon as that bound is below the score of the k-th best document so far, no new document can enter: what is left
of the lists is looked up for candidates only, and those fall out as their bounds drop. A task keeps the best k of
every query over all its shards, so most shards are left after their bounds alone. The best of all tasks are ranked
per query; a document whose bound equals the k-th score is never skipped, so ties are exact.

Repeated rows are documents of their own; a null id ranks behind other equal scores. Rows of queries that repeat an
id are one query with the terms of all. Null texts have no terms and appear in no result. Very long texts are read in
parts. An empty table of documents or queries gives an empty result. Only ``doc_id``, ``text`` and ``item_id``,
``text`` are read. Terms are compared by 64-bit hashes.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.llm.blocks import freeze, thaw
from fenceline.llm.common import blocks, word_hashes
from fenceline.sources.shared import materialize

TOP = 50
#: Bytes of text in a shard, and in one pass over its texts.
SHARD = 8_000_000
PASS = 2_000_000
#: Query terms whose lists are made in one pass; a block has at least one query.
BLOCK_TERMS = 100_000

#: All ASCII characters but letters and digits part terms.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[:128] = [not chr(c).isalnum() for c in range(128)]
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, long ones cut between terms, in runs of about ``PASS`` bytes with the number of each part's text."""
    numbers, run, held = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            cut = _BREAK.search(text, at + PASS) if len(text) - at > PASS else None
            part = text[at : cut.start() if cut else len(text)]
            if run and held + len(part) > PASS:
                yield numbers, run
                numbers, run, held = [], [], 0
            numbers.append(k)
            run.append(part)
            held += len(part)
            at += len(part)
    if run:
        yield numbers, run


def term_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and the number of the text of each, which ascends."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for numbers, run in parts(texts):
        h, bounds = word_hashes(run, breaks=_BREAKS)
        hashes.append(h)
        docs.append(np.repeat(np.array(numbers, dtype=np.int32), np.diff(bounds)))
    return np.concatenate(hashes), np.concatenate(docs)


@dataclass
class Shard:
    """Postings by term: the lists of term k are ``docs`` and ``counts`` from ``starts[k]`` to ``starts[k + 1]``."""

    ids: list
    lengths: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[bytes]) -> "Shard":
        h, doc = term_rows(texts)
        lengths = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new_term = np.ones(len(h), dtype=bool)
        new_term[1:] = h[1:] != h[:-1]
        new = new_term.copy()
        new[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(h))).astype(np.int32)
        starts = np.flatnonzero(new_term[first])
        return Shard(ids, lengths, h[first][starts], np.append(starts, len(first)), doc[first], counts)


def index(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The stored index: a row per shard with its documents that have terms, its terms with repeats, and postings."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = ((i, t.as_py()) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
        held, ids, texts = 0, [], []

        def out():
            s = Shard.of(ids, texts)
            payload = freeze((s.ids, s.lengths, s.terms, s.starts, s.docs, s.counts))
            columns = [pa.array([int((s.lengths > 0).sum())]), pa.array([int(s.lengths.sum())]), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "payload"])

        for i, text in rows:
            text = text or b""
            if ids and held + len(text) > size:
                yield out()
                held, ids, texts = 0, [], []
            ids.append(i)
            texts.append(text)
            held += len(text)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return materialize(rows.mapInArrow(run, "n_docs long, n_terms long, payload binary"), "index")


# --- queries ----------------------------------------------------------------------------------------


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each query as signed hashes."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded=True):
                h, doc = term_rows(texts)
                ends = np.searchsorted(doc, np.arange(1, len(texts)))
                found = [np.unique(x).view(np.int64) for x in np.split(h, ends)]
                arrays = [pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    found = rows.mapInArrow(run, "item_id long, terms array<long>")
    return found.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def query_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Queries in order of id, in blocks of at most ``most`` terms (or one query)."""
    block, held = [], 0
    for row in materialize(query_terms(items), "items").orderBy("item_id").toLocalIterator():
        terms = np.array(row["terms"], dtype=np.int64).view(np.uint64)
        if block and held + len(terms) > most:
            yield block
            block, held = [], 0
        block.append((row["item_id"], terms))
        held += len(terms)
    if block:
        yield block


@dataclass
class Block:
    """A block of queries: its terms, their weights, each query's terms by ascending weight, and the pairs."""

    terms: np.ndarray
    weights: np.ndarray
    items: list
    chains: list[np.ndarray]  # places in ``terms``
    pairs: np.ndarray  # distinct (term, term) rows, by place
    links: list[np.ndarray]  # for each query the pair of each two neighbours of its chain


def weight(docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency + 1)))


def block_of(queries: list, terms: np.ndarray, weights: np.ndarray) -> Block:
    """``weights`` of terms that no document has are zero; a term of weight zero adds nothing to a score."""
    chains = []
    for _, own in queries:
        at = np.searchsorted(terms, own)
        at = at[weights[at] > 0]
        chains.append(at[np.lexsort((at, weights[at]))])
    neighbours = [np.stack([c[:-1], c[1:]], axis=1) for c in chains]
    pairs, inverse = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *neighbours]), axis=0, return_inverse=True)
    links = np.split(inverse.reshape(-1), np.cumsum([len(n) for n in neighbours])[:-1])
    return Block(terms, weights, [i for i, _ in queries], chains, pairs, links)


# --- lists and search -------------------------------------------------------------------------------


@dataclass
class Lists:
    """A shard's lists for a block: per term of the block documents and impacts, per pair the joint maximum (0: none)."""

    ids: list
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    highest: np.ndarray
    joint: np.ndarray


def impacts(counts: np.ndarray, lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What one unit of weight adds to a score, for postings with these counts in documents of these lengths."""
    damping = 50 + 50 * lengths * docs // terms
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * damping)


def lists_of(shard: Shard, block: Block, docs: int, terms: int) -> Lists:
    at = np.minimum(np.searchsorted(shard.terms, block.terms), max(0, len(shard.terms) - 1))
    there = (shard.terms[at] == block.terms if len(shard.terms) else np.zeros(len(block.terms), bool)) & (block.weights > 0)
    sizes = np.where(there, (shard.starts[1:] - shard.starts[:-1])[at] if len(shard.terms) else 0, 0)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # The wanted postings one term after the other.
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes) + np.repeat(shard.starts[at], sizes) if starts[-1] else np.zeros(0, np.int64)
    own = shard.docs[place]
    gain = impacts(shard.counts[place], shard.lengths[own], docs, terms) * np.repeat(block.weights, sizes)
    highest = np.zeros(len(block.terms), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        highest[full] = np.maximum.reduceat(gain, starts[:-1][full])
    return Lists(shard.ids, starts, own, gain, highest, joint_maxima(block.pairs, starts, own, gain, len(shard.ids)))


def joint_maxima(pairs: np.ndarray, starts: np.ndarray, docs: np.ndarray, gain: np.ndarray, n: int) -> np.ndarray:
    """For each pair the largest sum of both impacts in the intersection of their lists; 0 where that is empty."""
    out = np.zeros(len(pairs), dtype=np.int64)
    dense, spread = np.zeros(n, dtype=np.int64), -1
    for k, (a, b) in enumerate(pairs.tolist()):
        la, lb = slice(starts[a], starts[a + 1]), slice(starts[b], starts[b + 1])
        if la.start == la.stop or lb.start == lb.stop:
            continue
        if spread != a:  # pairs are sorted by their first term
            dense[:] = 0
            dense[docs[la]] = gain[la]
            spread = a
        other = dense[docs[lb]]
        both = other > 0
        if both.any():
            out[k] = (other + gain[lb])[both].max()
    return out


def bounds(highest: list[int], joint: list[int]) -> list[int]:
    """What the i lightest terms add at most, i from 0 on: the least over all cuts into terms and neighbouring pairs."""
    out = [0]
    for k, h in enumerate(highest):
        bound = out[-1] + h
        if k:
            bound = min(bound, out[-2] + max(joint[k - 1], highest[k - 1], h))
        out.append(bound)
    return out


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score that a document must reach to be among the best."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.scores = np.append(self.scores, scores)
        self.known = np.append(self.known, [i is not None for i in ids])
        self.ids = np.append(self.ids, np.array([i or 0 for i in ids], dtype=np.int64))
        order = np.lexsort((self.ids, ~self.known, -self.scores))[: self.k]
        self.scores, self.ids, self.known = self.scores[order], self.ids[order], self.known[order]


def search(lists: Lists, chain: np.ndarray, links: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with a shard's documents; returns how many postings were read."""
    limit = bounds(lists.highest[chain].tolist(), lists.joint[links].tolist())
    least, read = best.least, 0
    score = np.zeros(len(lists.ids), dtype=np.int64)
    k = len(chain)
    # Heavy terms: every document in their lists may still enter.
    while k and limit[k] >= least:
        k -= 1
        own = slice(lists.starts[chain[k]], lists.starts[chain[k] + 1])
        if own.start < own.stop:
            score[lists.docs[own]] += lists.impacts[own]
            read += own.stop - own.start
            if len(score) >= best.k:
                least = max(least, int(np.partition(score, -best.k)[-best.k]))
    # Light terms: only documents already met, as long as they can reach the best.
    found = np.flatnonzero((score > 0) & (score + limit[k] >= least))
    while k and len(found):
        k -= 1
        own = slice(lists.starts[chain[k]], lists.starts[chain[k] + 1])
        docs = lists.docs[own]
        if len(docs):
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            score[found] += np.where(docs[at] == found, lists.impacts[own][at], 0)
            read += len(found)
        found = found[score[found] + limit[k] >= least]
    found = found[score[found] >= least]
    if len(found):
        best.add(score[found], [lists.ids[d] for d in found.tolist()])
    return read


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each query."""
    shards = index(docs)
    totals = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    results = [_ranked(shards, *totals, queries, k) for queries in query_blocks(items)] if totals[0] else []
    if len(results) > 1:
        results = [materialize(r, "ranked") for r in results]
    none = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results) if results else none


def _ranked(shards: DataFrame, n_docs: int, n_terms: int, queries: list, k: int) -> DataFrame:
    terms = np.unique(np.concatenate([own for _, own in queries]))

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for payload in batch.column(0):
                s = Shard(*thaw(payload.as_py()))
                if len(s.terms):
                    at = np.minimum(np.searchsorted(s.terms, terms), len(s.terms) - 1)
                    total += np.where(s.terms[at] == terms, np.diff(s.starts)[at], 0)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["term", "n"])

    # At most as many rows as the block has terms.
    frequencies = shards.select("payload").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    weights = np.zeros(len(terms), dtype=np.int64)
    for row in frequencies.collect():
        weights[row["term"]] = weight(n_docs, row["n"])
    block = block_of(queries, terms, weights)

    def make(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                lists = lists_of(Shard(*thaw(payload.as_py())), block, n_docs, n_terms)
                frozen = freeze((lists.ids, lists.starts, lists.docs, lists.impacts, lists.highest, lists.joint))
                yield pa.RecordBatch.from_arrays([pa.array([frozen], pa.binary())], ["payload"])

    lists = materialize(shards.select("payload").mapInArrow(make, "payload binary"), "lists")

    def find(batches) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block.items]
        for batch in batches:
            for payload in batch.column(0):
                shard = Lists(*thaw(payload.as_py()))
                for own, chain, links in zip(best, block.chains, block.links):
                    search(shard, chain, links, own)
        for item, own in zip(block.items, best):
            if len(own.ids):
                arrays = [
                    pa.array([item] * len(own.ids), pa.int64()),
                    pa.array(own.ids, pa.int64(), mask=~own.known),
                    pa.array(own.scores, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["item_id", "doc_id", "score"])

    found = lists.mapInArrow(find, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("item_id", "rank", "doc_id", "score")


#: The same rows for one engine that reads everything at once.
SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), postings AS (
    SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs WHERE len(terms) > 0
), counted AS (
    SELECT r, doc_id, n, term, count(*) AS tf FROM postings GROUP BY r, doc_id, n, term
), totals AS (
    SELECT count(*) AS N_docs, CAST(sum(len(terms)) AS BIGINT) AS L FROM docs WHERE len(terms) > 0
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * N_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM counted, totals GROUP BY term, N_docs
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, r, doc_id,
        CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_docs) // L)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN counted USING (term), totals
    GROUP BY item_id, r, doc_id
), placed AS (
    SELECT item_id, doc_id, score, row_number() OVER (
        PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 50
"""
