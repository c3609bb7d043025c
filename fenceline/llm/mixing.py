"""Mixing sources to target weights by hash thresholds.

Every document gets a fixed 60-bit hash. Words are summed by source and hash bucket; running sums over the
buckets of a source show in which bucket its budget runs out, and only that bucket is split further, level
by level. What remains is one threshold per source: documents below it are taken, the few rows that share
the last bucket are taken in hash order until the budget is used up, the last of them in part. Nothing is
sorted but those rows.

A null text has size 0. A null source is a source of its own, ordered last. Rows that repeat an id share
its hash and are told apart by size only, so equal rows may swap places without changing the result. An
empty table gives an empty result; columns besides ``doc_id``, ``source`` and ``text`` are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.llm import common
from fenceline.sources.shared import materialize

WEIGHTS = (3, 1, 2)
#: The words of the mix as a share of all words, and how often a document may be repeated.
SHARE = 1.5
REPEATS = 2
#: Each level splits a bucket into 2^BITS; LEVELS * BITS bits of the hash are used.
BITS, LEVELS = 10, 4
#: Further levels, by a hash of the row, where rows are repeated.
ROW_LEVELS = 2


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5, which SQL engines agree on; a null id counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source from rows (source, size): source_size, target, in words.

    Targets are in proportion to the weights but stop at ``repeats`` times the source's size. Ordered by that
    limit per weight, the first source whose limit is not below the common level fixes the level. The windows
    run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", repeats * F.col("source_size"))
    by_limit = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    )
    per = per.withColumn("rank", F.row_number().over(by_limit)).withColumn("rest", rest)
    fits = F.when(F.col("rest") <= F.col("cap") / F.col("weight"), F.struct("rank", "rest"))
    per = per.withColumn("level", F.min(fits).over(whole)["rest"])
    reached = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (reached > F.col("cap")), F.col("cap").cast("double")).otherwise(reached)
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For each source of ``budgets`` (source, extra): the bucket at which the running words of
    ``sized`` (source, code, size) pass ``extra``, and the words left for that bucket."""
    found = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("extra").alias("left"))
    for level in range(1, levels + 1):
        shift = BITS * (levels - level)
        here, above = F.shiftright("code", shift), F.shiftright("code", shift + BITS)
        inside = sized.alias("s").join(
            found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")) & (above == F.col("f.prefix"))
        )
        hist = inside.groupBy(F.col("s.source").alias("source"), here.alias("bucket"), F.col("f.left").alias("left")).agg(
            F.sum("size").alias("words")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(running))
        # The first bucket that reaches the budget; a budget that all rows reach only together ends there.
        hist = hist.where("upto >= left AND words > 0")
        first = hist.groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))).alias("b")
        )
        found = materialize(first.select("source", F.col("b.bucket").alias("prefix"), F.col("b.left").alias("left")), "mix")
    return found


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(f"[^{common.SPACE}]+")), F.lit(0)).cast("long")


def _taken(sized: DataFrame, weights, share: float, repeats: int, levels: int = LEVELS) -> DataFrame:
    """``sized`` (source, size, code of ``levels`` * BITS bits, h, ...) with source_size, target and taken."""
    words = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialize(
        source_targets(sized, weights, share, repeats)
        .withColumn("rounds", rounds)
        .withColumn("extra", words - F.col("rounds") * F.col("source_size")),
        "targets",
    )
    edges = thresholds(sized, targets.where("extra > 0").select("source", "extra"), levels)
    plan = targets.alias("t").join(edges.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
    plan = plan.select("t.*", "e.prefix", "e.left")
    rows = sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("s.*", "p.source_size", "p.target", "p.rounds", "p.prefix", "p.left")
    # Rows of the last bucket, a 2^-40 share of a source and the copies of one id, are taken in order.
    before = Window.partitionBy("source").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("code = prefix").withColumn("room", F.col("left") - F.coalesce(F.sum("size").over(before), F.lit(0)))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("room"), F.col("size"))))
    rest = rows.where("prefix IS NULL OR code <> prefix").withColumn(
        "extra", F.when(F.col("code") < F.col("prefix"), F.col("size")).otherwise(0)
    )
    kept = [F.col(c) for c in sized.columns if c not in ("source", "h", "code")]
    columns = (*kept, "source_size", "target", (F.col("rounds") * F.col("size") + F.col("extra")).alias("taken"))
    return rest.select(*columns).unionByName(edge.select(*columns))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``."""
    hashed = hash60(F.col("doc_id"))
    code = F.shiftright(hashed, 60 - BITS * LEVELS)
    sized = docs.select("doc_id", "source", _size().alias("size"), hashed.alias("h"), code.alias("code"))
    return _taken(materialize(sized, "sizes"), weights, share, repeats)


def repeated(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; one taken in part stays if that is half or more.

    Each row counts on its own. Rows are in the order of their id's hash as in ``mix``, and those that repeat
    an id or have none in that of a hash of the row, so a source keeps its share of them whatever the others
    keep. Rows without words count for nothing and are kept once."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.xxhash64("text", *columns)
    # 40 bits of the id's hash and 20 of the row's, so that one id's rows are split like those of many.
    low = BITS * ROW_LEVELS
    code = F.shiftleft(F.shiftright(hash60(F.col("doc_id")), 60 - BITS * LEVELS), low) + own.bitwiseAND((1 << low) - 1)
    sized = docs.select(F.struct(*columns).alias("_row"), "source", _size().alias("size"), own.alias("h"), code.alias("code"))
    taken = _taken(materialize(sized, "sizes"), weights, share, repeats, LEVELS + ROW_LEVELS)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).select("_row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
               [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
        FROM sized GROUP BY source),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget, sum(weight) AS weights FROM per),
lim AS (SELECT *, row_number() OVER w AS rank,
               (budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
               / (weights - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest
        FROM per, total WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
lev AS (SELECT min({'rank': rank, 'rest': rest}) AS m FROM lim WHERE rest <= cap::DOUBLE / weight),
tgt AS (SELECT source, source_size, CASE WHEN m IS NULL OR m.rest * weight > cap THEN cap::DOUBLE ELSE m.rest * weight END AS target
        FROM lim, lev),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds FROM tgt),
run AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.rounds, round(p.target)::BIGINT - p.rounds * p.source_size AS extra,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM run
"""
