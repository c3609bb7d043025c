"""Documents whose word n-gram sets overlap, by vertical partitioning.

Documents with equal sets form a class. Every class sends its n-grams to fragments of the hash range, which
find the n-grams that several classes share; the others cannot count towards any overlap and end there. With
the counts the shared n-grams have a global order, rare ones first, and every class that shares enough of its
set is cut at the borders of that order. Two classes are compared if they share an n-gram among the first few
that the threshold allows to differ. Per fragment the overlap is counted separately and summed per pair.

A frequent n-gram's classes are not all paired: they are first compared with a few leaders, and only classes
that are then in different components meet each other. A pair that is never compared is in one component
already, so no component is lost. Pairs also have to fit: by size, by what can follow their n-gram in the
global order, and, where all meet, by bitmaps of their sets: bits in which two maps differ, and n-grams that no other
class has, are members of one set alone, and sets that link have few of those. Longer leads, keyed by several
n-grams, were measured and do not tell such classes apart: texts around one passage share them all.

A text without words (null, empty) has the empty set and is linked with nothing. A null id counts as larger
than all others. Repeated rows are copies of each other. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read.
"""

import hashlib
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.llm import blocks, common
from fenceline.llm.graph import components
from fenceline.sources.shared import materialize

WORDS = 5
#: Text bytes behind one fragment of the hash range, and in one pass over texts.
FRAGMENT, PASS = 12_000_000, 6_000_000
#: The classes of an n-gram are compared with so many leaders, in so many rounds with others, before all
#: that are still apart meet.
LEADERS, ROUNDS = 8, 2
#: 64-bit words of a set's bitmap.
BITMAP = 8


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    out = []
    for _, some in common.blocks(texts, texts, 500_000, encoded=True):
        h, bounds = common.word_hashes(some)
        for a, b in zip(bounds[:-1], bounds[1:]):
            grams = np.sort(common.shingle_hashes(h[a:b], WORDS))
            out.append(grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams)
    return out


def _class(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63


def _members(digests: bool):
    """Class and number of n-grams of each row, with the MD5 of its text if ``digests``."""

    def run(batches):
        for batch in batches:
            for ids, texts in common.blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), PASS):
                sets = _sets(texts)
                out = {
                    "doc_id": pa.array(ids, pa.int64()),
                    "cls": pa.array([_class(s) for s in sets]),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                }
                if digests:
                    out["digest"] = pa.array([hashlib.md5(t).hexdigest() for t in texts])
                yield pa.RecordBatch.from_pydict(out)

    return run


def _spread(n: int):
    """Every pass's n-grams by fragment: which classes, how many of each, and the n-grams."""

    def run(batches):
        for batch in batches:
            for _, texts in common.blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), PASS):
                sets = {_class(s): s for s in _sets(texts) if len(s)}
                if not sets:
                    continue
                keys = np.fromiter(sets, dtype=np.int64, count=len(sets))
                grams = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(keys)), [len(s) for s in sets.values()])
                fragment = ((grams >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(fragment, kind="stable")
                grams, owner, fragment = grams[order], owner[order], fragment[order]
                edges = np.searchsorted(fragment, np.arange(n + 1))
                rows = []
                for f in range(n):
                    a, b = edges[f], edges[f + 1]
                    if a < b:
                        begins = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
                        own, counts = owner[a:b][begins], np.diff(begins, append=b - a)
                        part = (keys[own], counts.astype(np.uint32), grams[a:b])
                        rows.append((f, pickle.dumps(part, 5)))
                yield from blocks.chunks(rows, ["fragment", "part"])

    return run


def _shared(n: int):
    """In one fragment: the n-grams of at least two classes, dealt to buckets of classes."""

    def run(key, table):
        parts = [pickle.loads(p.as_buffer()) for p in table.column("part")]
        grams = np.concatenate([g for _, _, g in parts])
        owner = np.concatenate([np.repeat(k, c) for k, c, _ in parts])
        order = np.argsort(grams)
        grams, owner = grams[order], owner[order]
        same = grams[1:] == grams[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        grams, owner = grams[keep], owner[keep]
        # A class that several passes sent counts once.
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        first = np.ones(len(grams), dtype=bool)
        first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[first], owner[first]
        _, begins, number = common.grouped(grams)
        count = np.diff(begins, append=len(grams))[number]
        keep = count > 1
        grams, owner, count = grams[keep], owner[keep], count[keep].astype(np.uint32)
        bucket = owner % n
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n + 1))
        rows = []
        for b in range(n):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                rows.append((b, blocks.freeze((owner[at], grams[at], count[at]))))
        return blocks.batch_of("bucket long, part binary", [list(c) for c in zip(*rows)] if rows else [[], []])

    return run


_CUT = "cls long, n long, alone long, first array<long>, bits array<long>, fragments array<int>, grams array<array<long>>"
_CUT_ARROW = pa.schema(
    [
        ("cls", pa.int64()),
        ("n", pa.int64()),
        ("alone", pa.int64()),
        ("first", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.int64())),
        ("fragments", pa.list_(pa.int32())),
        ("grams", pa.list_(pa.list_(pa.int64()))),
    ]
)


def _bitmap(grams: np.ndarray) -> np.ndarray:
    """A bit for each n-gram; its place is the top bits of the mixed hash."""
    place = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (64 * BITMAP - 1).bit_length())
    bits = np.zeros(64 * BITMAP, np.uint8)
    bits[place.astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _cut(key, parts, classes):
    """Classes that share enough, their n-grams in the global order (how many classes have it, as a power of
    two, then hash) and cut into its fragments; ``first``: those that may lead to a partner; ``alone``: how many
    no other class has; ``bits``: a bitmap of the shared ones."""
    found = [blocks.thaw(p.as_py()) for p in parts.column("part")]
    rows = []
    if found:
        size = dict(zip(classes.column("cls").to_pylist(), classes.column("n").to_pylist()))
        owner, grams, count = (np.concatenate(c) for c in zip(*found))
        level = np.ceil(np.log2(count)).astype(np.int64)
        order = np.lexsort((grams, level, owner))
        owner, grams = owner[order], grams[order]
        # Fragments of the global order: levels 1 to 3 in two halves by hash, then all frequent n-grams.
        fragment = np.where(level[order] < 4, level[order] * 2 + (grams >> np.uint64(63)).astype(np.int64), 8)
        borders = np.append(True, (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1]))
        keys, starts = np.unique(owner, return_index=True)
        for cls, a, b in zip(keys.tolist(), starts, np.append(starts[1:], len(owner))):
            n = size[cls]
            needed = -(-4 * n // 5)
            # An n-gram that no other class has comes before all shared ones.
            alone = n - int(b - a)
            leading = (n - needed + 1) - alone
            if leading <= 0:
                continue
            own, at = grams[a:b].view(np.int64), fragment[a:b]
            begins = np.flatnonzero(borders[a:b])
            rows.append((cls, n, alone, own[:leading], _bitmap(grams[a:b]), at[begins].astype(np.int32), np.split(own, begins[1:])))
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in _CUT_ARROW]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _CUT_ARROW)]
    return pa.Table.from_arrays(arrays, schema=_CUT_ARROW)


def _fits() -> Column:
    """Whether sets a and b can link through an n-gram at places p_a and p_b of their orders, if they share
    none before it: by their sizes, and by how many n-grams follow in each."""
    sizes = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    follow = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    return sizes & (9 * (1 + follow) >= 4 * (F.col("n_a") + F.col("n_b")))


def verified(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """Pairs (a, b) whose n-gram sets link: overlaps counted by fragment and summed."""
    parts = cut.select("cls", "n", F.explode(F.arrays_zip("fragments", "grams")).alias("p"))
    parts = parts.select("cls", "n", F.col("p.fragments").alias("fragment"), F.col("p.grams").alias("grams"))
    left = parts.toDF("a", "n_a", "fragment", "grams_a")
    right = parts.toDF("b", "n_b", "fragment", "grams_b")
    partial = pairs.join(left, "a").join(right, ["b", "fragment"])
    overlap = partial.groupBy("a", "b", "n_a", "n_b").agg(
        F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("overlap")
    )
    return overlap.where("100 * overlap >= 80 * (n_a + n_b - overlap)").select("a", "b")


def _postings(cut: DataFrame) -> DataFrame:
    """(gram, cls, n, p) of the n-grams that lead to partners and that two classes at least have there."""
    at = cut.select("cls", "n", "alone", F.posexplode("first").alias("i", "gram"))
    post = materialize(at.select("gram", "cls", "n", (F.col("alone") + F.col("i") + 1).alias("p")), "postings")
    sizes = post.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1")
    return materialize(post.join(sizes, "gram").drop("m"), "postings")


def _labelled(post: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings with the component of each class, of n-grams whose classes are in several components."""
    if labels is None:
        return post.withColumn("label", F.col("cls"))
    found = post.join(labels, post["cls"] == labels["node"], "left").drop("node")
    found = materialize(found.withColumn("label", F.coalesce("label", "cls")), "postings")
    apart = found.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return found.join(apart.select("gram"), "gram")


def _pairs(some: DataFrame, others: DataFrame, mapped: bool = False) -> DataFrame:
    columns = ["gram", "cls", "n", "p", "label"] + ["alone", "bits"] * mapped
    a = some.select(*[F.col(c).alias(c if c == "gram" else f"{c}_a") for c in columns])
    b = others.select(*[F.col(c).alias(c if c == "gram" else f"{c}_b") for c in columns])
    fits = (F.col("label_a") != F.col("label_b")) & _fits()
    if mapped:  # either order is the same pair
        fits &= (F.col("cls_a") < F.col("cls_b")) & _may_link()
    met = a.join(b, (a["gram"] == b["gram"]) & fits)
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def _may_link() -> Column:
    """Whether few enough n-grams are known to be in one of sets a and b alone: those that no other class has, and one at
    least for each bit that differs. Sets of which 0.8 of the union is shared have a ninth of their sizes' sum at most."""
    differ = [F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(BITMAP)]
    return 9 * (F.col("alone_a") + F.col("alone_b") + reduce(Column.__add__, differ)) <= F.col("n_a") + F.col("n_b")


def links(cut: DataFrame) -> DataFrame:
    """(cls, label) of the components of all linked classes."""
    post, found, labels = _postings(cut), None, None
    for round_ in range(ROUNDS + 1):
        open_ = _labelled(post, labels)
        if round_ < ROUNDS:
            order = Window.partitionBy("gram").orderBy(F.xxhash64("cls", F.lit(round_)), "cls")
            heads = open_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEADERS)
            pairs = _pairs(heads, open_)
        else:
            mapped = materialize(open_.join(cut.select("cls", "alone", "bits"), "cls"), "apart")
            pairs = _pairs(mapped, mapped, mapped=True)
        new = materialize(verified(pairs, cut), "links")
        found = new if found is None else found.unionByName(new)
        labels = components(found)
    return labels


def _grouped(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, cls, n and, if ``digests``, digest for every row of ``docs``, with the smallest id of its
    component and the component's own key ``label``; both are null without words."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    n = max(1, -(-common.text_bytes(docs) // FRAGMENT))
    schema = "doc_id long, cls long, n long" + (", digest string" if digests else "")
    members = materialize(rows.mapInArrow(_members(digests), schema), "members")
    classes = members.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("id"))
    classes = materialize(classes, "classes")
    spread = rows.mapInArrow(_spread(n), "fragment long, part binary")
    shared = spread.groupBy("fragment").applyInArrow(_shared(n), "bucket long, part binary")
    sizes = classes.select(F.pmod("cls", F.lit(n)).alias("bucket"), "cls", "n")
    cut = materialize(shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_cut, _CUT), "cut")
    labels = links(cut)
    linked = labels.join(classes, labels["node"] == classes["cls"])
    least = linked.groupBy("label").agg(F.min("id").alias("component"))
    linked = linked.join(least, "label").select("cls", "label", "component")
    by_class = classes.join(linked, "cls", "left").select(
        "cls", F.coalesce("label", "cls").alias("label"), F.coalesce("component", "id").alias("component")
    )
    return members.join(by_class, "cls", "left")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, columns unchanged: the one of smallest id, then of smallest digest of text and
    row; rows without an id come last, and leave if their group has one with an id. Rows that repeat an id belong
    to the groups of their own texts. Texts without words are in no group: those with an id stay once for each id,
    those without all stay. Columns may have any names and types."""
    found = _grouped(docs, digests=True)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("one")
    kept = found.where("n > 0").groupBy("label").agg(first).select("one.doc_id", "one.digest")
    empty = found.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "digest").groupBy("doc_id")
    kept = kept.unionByName(empty.agg(F.min("digest").alias("digest"))).distinct()
    # The row travels as one value, so that no name of its columns can clash.
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("own"),
        F.md5(text.cast("binary")).alias("digest"),
        (F.col("doc_id").isNull() & ~text.rlike(f"[^{common.SPACE}]")).alias("bare"),
    )
    same = packed["own"].eqNullSafe(kept["doc_id"]) & (packed["digest"] == kept["digest"])
    one = packed.where(~F.col("bare")).join(kept, same, "left_semi")
    # Rows of the same id and text are copies of each other; which stays follows from the rest of the row.
    one = one.groupBy("own", "digest").agg(F.min_by("row", F.to_json(F.struct("row"))).alias("row"))
    return one.select("row").unionByName(packed.where("bare").select("row")).select("row.*")
