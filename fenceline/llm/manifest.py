"""A Merkle manifest of a table as a content-addressed graph, and proofs by descent from its root.

Every row is a leaf, the digest of its columns. Leaves of a language in order of id are paired level by level
until one digest, the subroot, remains; the subroots in order of language are paired likewise into the root.
A node's digest is that of its children's digests, so a digest names its whole subtree.

The store holds ``digest -> children`` records. Records of ``LEVELS`` levels lie together in one row, a segment,
under the digest of their top node, so a tree of n leaves has about n / 4096 segments and every step up or down
crosses twelve levels. Segments are built by groups of at most 4096 neighbours.

A leaf request descends from the root: at each node the next binary digit of its rank picks one child, and the
other one, if any, is collected. Requests that share a segment share the way to it, which is walked once for all;
collected digests are reversed at the end, as a proof is read from the leaf up. The same walk leads through the
tree of subroots first. So no node, not even the root, is asked for more often than it has segments or leaves
below it, at most 4096 times.

Ranks need no ordering of a whole language in one task: rows are sorted by range, numbered inside a range, and
the ranges of a language are added up.

A null column is ``-``. Null ids come first in their language, a null language is a language of its own and comes
first; rows that repeat an id are leaves of their own, ordered by digest. Null ids are not tampered with. An
empty table gives an empty result. Only ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` are read.
"""

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize

#: Levels of a segment; it has at most 2 ** LEVELS children below its lowest records.
LEVELS = 12
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- leaves and ranks -------------------------------------------------------------------------------


def _leaf(columns: dict[str, Column]) -> Column:
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(columns[n]) for n in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, shown) where ``shown`` is the leaf of the row as tampered with."""
    columns = {n: F.col(n) for n in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return docs.select("doc_id", "lang", _leaf(columns).alias("leaf"), _leaf(columns | {"n_chars": n_chars}).alias("shown"))


def ranked(df: DataFrame, group: str, order: list[str], more: DataFrame | None = None) -> DataFrame:
    """Add ``rank``, from 0 in each group by ``order``, nulls first, without one task per group, and the columns that
    ``more`` has for a group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    # The running id of a sorted partition holds its number above and the row's place in it below.
    stored = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    ranges = stored.groupBy(F.col(group).alias("__group"), part.alias("__part"))
    ranges = ranges.agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    starts = ranges.select("__group", "__part", shift.alias("__shift"))
    names = []
    if more is not None:
        names = [c for c in more.columns if c != group]
        starts = starts.join(more.withColumnRenamed(group, "__key"), F.col("__group").eqNullSafe(F.col("__key")))
    same = stored[group].eqNullSafe(starts["__group"]) & (part == starts["__part"])
    return stored.join(starts, same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias("rank"), *names)


def height(n: Column) -> Column:
    """How often n neighbours are paired until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("long")


# --- the store --------------------------------------------------------------------------------------

Records = dict[str, tuple[str, ...]]


def grow(nodes: list[str], levels: int) -> tuple[list[str], Records]:
    """Pair neighbours ``levels`` times; the digests that remain and the records of all new nodes."""
    records: Records = {}
    for _ in range(levels):
        pairs = [tuple(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        nodes = [digest(*p) for p in pairs]
        records |= zip(nodes, pairs)
    return nodes, records


def frozen(records: Records) -> bytes:
    """Records one after the other: how many children, the digest, the children."""
    return b"".join(bytes([len(c)]) + bytes.fromhex(d + "".join(c)) for d, c in records.items())


def thawed(payload: bytes) -> Records:
    out, at = {}, 0
    while at < len(payload):
        n, at = payload[at], at + 1
        d, *children = (payload[at + DIGEST * k : at + DIGEST * (k + 1)].hex() for k in range(n + 1))
        out[d] = tuple(children)
        at += DIGEST * (n + 1)
    return out


SEGMENT = "tree long, place long, digest string, levels long, records binary"
_ARROW = {
    "long": pa.int64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    columns = [pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)]
    return pa.Table.from_arrays(columns, [n for n, _ in fields])


@dataclass
class Store:
    """Segments of a forest by height, lowest first, and its trees (tree, levels, root)."""

    segments: list[DataFrame]
    trees: DataFrame


def _at_height(k: int) -> Column:
    """Trees whose top lies in segments of height ``k``; a tree of one leaf has a segment without records."""
    return (F.col("levels") <= (k + 1) * LEVELS) & ((F.col("levels") > k * LEVELS) | F.lit(k == 0))


def build(nodes: DataFrame) -> Store:
    """Trees over (tree, rank, digest, levels); ranks of a tree run from 0 without gaps."""
    tallest = nodes.agg(F.coalesce(F.max("levels"), F.lit(0))).first()[0]
    segments: list[DataFrame] = []
    while not segments or len(segments) * LEVELS < tallest:
        segments.append(_segments(nodes, len(segments) * LEVELS))
        above = segments[-1].where(F.col("levels") > len(segments) * LEVELS)
        nodes = above.select("tree", F.col("place").alias("rank"), "digest", "levels")
    tops = [s.where(_at_height(k)).select("tree", "levels", F.col("digest").alias("root")) for k, s in enumerate(segments)]
    return Store(segments, materialize(reduce(DataFrame.unionByName, tops), "trees"))


def _segments(nodes: DataFrame, done: int) -> DataFrame:
    """Segments over nodes (tree, rank, digest, levels) that lie ``done`` levels above the leaves."""

    def run(key, table):
        levels = table.column("levels")[0].as_py()
        nodes = table.sort_by("rank").column("digest").to_pylist()
        (top,), records = grow(nodes, min(LEVELS, levels - done))
        return _table(SEGMENT, [(*(k.as_py() for k in key), top, levels, frozen(records))])

    keyed = nodes.select("tree", F.shiftright("rank", LEVELS).alias("place"), "rank", "digest", "levels")
    return materialize(keyed.groupBy("tree", "place").applyInArrow(run, SEGMENT), "segments")


# --- proofs -----------------------------------------------------------------------------------------


def walk(records: Records, top: str, digits: int, levels: int) -> tuple[str, list[str]]:
    """Descend by the digits of a rank, highest first: the digest reached and, top down, what was not picked
    (``""`` for an only child)."""
    at, passed = top, []
    for bit in range(levels - 1, -1, -1):
        children = records[at]
        pick = digits >> bit & 1
        at = children[pick]
        passed.append(children[1 - pick] if len(children) == 2 else "")
    return at, passed


def fold(leaf: str, rank: int, siblings: list[str]) -> str:
    """The root that a leaf and its siblings, lowest first, make."""
    for s in siblings:
        leaf = digest(s, leaf) if s and rank & 1 else digest(leaf, s)
        rank >>= 1
    return leaf


WAY = "tree long, place long, digest string, above array<string>"


def descend(store: Store, k: int, ways: DataFrame, requests: DataFrame, schema: str, finish) -> DataFrame:
    """Walk through the segments of height ``k``. ``ways`` leads to each of them (tree, place, digest, above, ...),
    ``requests`` (tree, rank, ...) end below them; ``finish(request, way, reached, passed)`` is a row of ``schema``,
    ``passed`` all that was not picked since the root, top down."""
    # Both parts of the key: the digest names the records, the place keeps equal subtrees apart.
    opened = store.segments[k].join(ways, ["tree", "place", "digest"])
    asked = requests.withColumn("place", F.shiftright("rank", LEVELS))

    def run(key, left, right):
        rows = []
        for way in left.to_pylist():
            records, levels = thawed(way["records"]), min(LEVELS, way["levels"] - k * LEVELS)
            for request in right.to_pylist():
                reached, passed = walk(records, way["digest"], request["rank"] & (1 << LEVELS) - 1, levels)
                rows.append(finish(request, way, reached, way["above"] + passed))
        return _table(schema, rows)

    return opened.groupBy("tree", "place").cogroup(asked.groupBy("tree", "place")).applyInArrow(run, schema)


def ways(store: Store, above: DataFrame) -> DataFrame:
    """The way to every lowest segment (tree, place, digest, above); ``above`` (tree, above) says what was not picked
    on the way to a tree's root."""
    trees = store.trees.join(above, "tree")
    found: DataFrame | None = None
    for k in range(len(store.segments) - 1, -1, -1):
        tops = trees.where(_at_height(k)).select("tree", F.lit(0).cast("long").alias("place"), F.col("root").alias("digest"), "above")
        if found is not None:
            inner = store.segments[k].where(F.col("levels") > (k + 1) * LEVELS).select("tree", F.col("place").alias("rank"))
            tops = tops.unionByName(descend(store, k + 1, found, inner, WAY, _way))
        found = materialize(tops, "ways")
    return found


def _way(request, way, reached, passed):
    return request["tree"], request["rank"], reached, passed


def _subroot(request, way, reached, passed):
    return request["rank"], reached, passed


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(rows: DataFrame) -> tuple[Store, Store, DataFrame]:
    """The trees of all languages over (doc_id, lang, leaf), the tree of their subroots, and the rows with ``tree`` and
    ``rank``."""
    langs = materialize(rows.groupBy("lang").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("all")), "languages")
    numbered = ranked(langs, "all", ["lang"]).select("lang", F.col("rank").alias("tree"), height(F.col("n")).alias("levels"))
    numbered = materialize(numbered, "languages")
    placed = materialize(ranked(rows, "lang", ["doc_id", "leaf"], numbered), "placed")
    trees = build(placed.select("tree", "rank", F.col("leaf").alias("digest"), "levels"))
    top = height(F.lit(numbered.count()))
    subroots = trees.trees.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("root").alias("digest"), top.alias("levels")
    )
    return trees, build(subroots), placed


def proofs(docs: DataFrame) -> DataFrame:
    """A row per document: its leaf, the digests above it, its proof's digest, and what the row as shown folds to."""
    trees, top, placed = manifest(materialize(leaves(docs), "leaves"))
    first = top.trees.first()
    root = first["root"] if first else None
    # The tree of subroots is walked first; the way to a subroot begins the ways of its tree.
    start = top.trees.select("tree", F.array().cast("array<string>").alias("above"))
    asked = trees.trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"))
    entered = descend(top, 0, ways(top, start), asked, "tree long, subroot string, above array<string>", _subroot)
    entered = materialize(entered, "subroots")
    below = ways(trees, entered.select("tree", "above")).join(entered.select("tree", "subroot"), "tree")

    def proof(request, way, reached, passed):
        siblings = passed[::-1]
        # The digits of the rank, and above them those of the language's place.
        folded = fold(request["shown"], request["tree"] << way["levels"] | request["rank"], siblings)
        return request["doc_id"], reached, way["subroot"], root, digest(*siblings), folded, folded == root

    requests = placed.select(F.col("doc_id").cast("long"), "tree", "rank", "shown")
    return descend(trees, 0, below, requests, PROOF, proof)


#: The same rows for one engine that reads everything at once: levels by recursion, CRC-32 by its table.
SQL = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step
    FROM range(256) AS t(i)
), rows AS (
    SELECT doc_id, lang, n_chars, list_transform(
        [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
        lambda v: CASE WHEN v IS NULL THEN '-' ELSE CAST(strlen(v) AS VARCHAR) || ':' || v END) AS fields,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
            lambda c, b: xor(c >> 8, step[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS crc
    FROM documents, crc
), leaves AS (
    SELECT doc_id, lang, sha256(array_to_string(fields, '')) AS leaf,
        sha256(array_to_string(list_transform(fields, lambda f, k: CASE
            WHEN k = 4 AND n_chars IS NOT NULL AND COALESCE(crc % 7 = 0, false)
            THEN CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR) ELSE f END), '')) AS shown
    FROM rows
), langs AS (
    SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
    FROM (SELECT DISTINCT lang FROM leaves)
), placed AS (
    SELECT doc_id, leaf, shown, tree, trees, count(*) OVER (PARTITION BY tree) AS n,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang
), nodes AS (
    SELECT tree, CAST(0 AS BIGINT) AS level, pos, leaf AS digest, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), top AS (
    SELECT CAST(0 AS BIGINT) AS level, tree AS pos, digest, (SELECT count(*) FROM langs) AS n FROM nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), heights AS (
    SELECT tree, max(level) AS levels, max(CASE WHEN n = 1 THEN digest END) AS subroot FROM nodes GROUP BY tree
), below AS (
    SELECT p.tree, p.pos, l.level,
        CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos < p.pos >> l.level THEN 'L' || s.digest ELSE 'R' || s.digest END AS step
    FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l ON l.tree = p.tree
    LEFT JOIN nodes s ON s.tree = p.tree AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
), above AS (
    SELECT g.tree, l.level,
        CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos < g.tree >> l.level THEN 'L' || s.digest ELSE 'R' || s.digest END AS step
    FROM langs g CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) l
    LEFT JOIN top s ON s.level = l.level AND s.pos = xor(g.tree >> l.level, 1)
), steps AS (
    SELECT p.doc_id, p.leaf, p.shown, h.subroot, (SELECT digest FROM top WHERE n = 1) AS root, list_concat(
        COALESCE((SELECT list(b.step ORDER BY b.level) FROM below b WHERE b.tree = p.tree AND b.pos = p.pos), []),
        COALESCE((SELECT list(a.step ORDER BY a.level) FROM above a WHERE a.tree = p.tree), [])) AS steps
    FROM placed p JOIN heights h ON h.tree = p.tree
)
SELECT doc_id, leaf, subroot, root,
    sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(shown, steps), lambda a, s: sha256(CASE s[1]
        WHEN '-' THEN a WHEN 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root,
    folded_root = root AS verified
FROM steps
"""
