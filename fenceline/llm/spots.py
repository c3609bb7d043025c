"""Document fingerprints from spots: chains of content words that follow common-word anchors.

A text is lower-cased and cut at everything that is neither letter nor digit. Every common word (anchor)
starts a chain of the content words after it, common words skipped; a chain's hash is a signature and the
set of signatures is the fingerprint. The anchors are the words that most documents of the table have. Where
``GAP`` words in a row hold no anchor, or nothing but anchors, the next word starts a chain too, so texts in
rare languages, word lists and code have as many signatures as their length gives and an edit changes only
those near it. A text in which all this finds no chain has the chains of its consecutive words, and one of
fewer words than a chain the hash of what it has. Equal texts always have equal fingerprints. Sets are
compared by Jaccard: where the sizes alone bound the likeness below a threshold the sets are not looked at,
and a join partitions them by size.

A null text counts as empty; all empty texts share one fingerprint. A null id comes before all others.
Rows that repeat an id are ordered by text. An empty table gives an empty result.
"""

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize

#: Where no table is at hand: frequent function words of English, German, French and Spanish.
ANCHORS = (
    "the a an of and to in is that it for on was be with as this by from are "
    "der die das und von mit den dem ein eine ist im zu auf nicht sich des für als auch "
    "le la les de des du et un une en que qui dans pour sur par est au avec il "
    "el los las del y una que por con no se lo su para es al como más"
).split()
#: Content words of a chain, and the step from one to the next.
CHAIN, STEP = 2, 1
#: How many words of a table are anchors, and the words in a row without a chain of their own.
COMMON, GAP = 128, 16
#: Rows that share one window of neighbouring ids.
BLOCK_ROWS = 4096


def _words(text: Column) -> Column:
    """The words of a text in order; one empty string for a text without words."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def common_words(docs: DataFrame) -> list[str]:
    """The words that most documents have, ``COMMON`` at most, ties by word; none that only one document has."""
    seen = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''")
    counts = seen.groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    return [r["word"] for r in counts.orderBy(F.desc("df"), "word").limit(COMMON).collect()]


def signatures(text: Column, anchors=ANCHORS) -> Column:
    """The sorted distinct 32-bit signatures of a text, as array<int>."""
    anchors = sorted(set(anchors))
    span = (CHAIN - 1) * STEP

    def chain(words: Column, first: Column) -> Column:
        taken = [F.get(words, first + j * STEP) for j in range(CHAIN)]
        return F.when(taken[-1].isNotNull(), F.hash(*taken))

    # Bound to names by nested single-element transforms, so that each array is made once per text.
    def of_words(w: Column) -> Column:
        content = F.filter(w, lambda x: (x != "") & ~x.isin(anchors))
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
        return F.struct(w.alias("w"), content.alias("c"), at.alias("a"))

    def of_parts(p: Column) -> Column:
        # The k-th anchor at i has i - k content words before it.
        def at_anchor(i: Column, k: Column) -> Column:
            crowded = F.get(p["a"], k + GAP) == i + GAP
            return F.when(crowded, chain(p["w"], i)).otherwise(chain(p["c"], i - k))

        def before_anchor(i: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(p["a"], k - 1) + 1, F.lit(0)) + GAP
            starts = F.when(begin < i, F.sequence(begin, i - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda j: chain(p["c"], j - k))

        lonely = F.flatten(F.transform(F.array_append(p["a"], F.size(p["w"])), before_anchor))
        found = F.concat(F.transform(p["a"], at_anchor), lonely)
        return F.struct(F.array_distinct(F.array_compact(found)).alias("s"), p["w"].alias("w"))

    def of_spots(q: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(q["w"]) - 1 - span), lambda i: chain(q["w"], i))
        whole = F.array(F.hash(F.array_join(q["w"], " ")))
        few = F.when(F.size(q["w"]) > span, F.array_distinct(every)).otherwise(whole)
        return F.sort_array(F.when(F.size(q["s"]) > 0, q["s"]).otherwise(few))

    return F.element_at(F.transform(F.transform(F.transform(F.array(_words(text)), of_words), of_parts), of_spots), 1)


def fingerprint(signs: Column) -> Column:
    """A set of signatures as text, eight hexadecimal digits each."""
    digits = F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard of two sets; null, without looking inside, where their sizes keep it below ``at_least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    jaccard = F.when(a == b, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))
    return jaccard if at_least <= 0 else F.when(small >= at_least * large, jaccard)


def similar(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs (id_a, id_b, likeness) of fingerprints with likeness of ``at_least``, ids being the smallest
    document of each fingerprint. Documents with equal fingerprints are one class: ``fingerprints`` of the
    same rows tells which.

    Sets are partitioned by size so that a set meets only its own and the next partition. Within these, two
    sets meet if they share one of their rarest signatures, as few as the threshold allows to differ.
    """
    anchors = common_words(docs)
    classes = (
        docs.select("doc_id", signatures(F.col("text"), anchors).alias("signs"))
        .groupBy("signs")
        .agg(F.min("doc_id").alias("id"))
        .withColumn("n", F.size("signs"))
    )
    part = F.floor(F.log(F.col("n")) / -log(at_least) + 1e-9)
    counts = classes.select(F.explode("signs").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    spread = classes.select("id", "n", part.alias("part"), F.explode("signs").alias("s")).join(counts, "s")
    rank = Window.partitionBy("id").orderBy("df", "s")
    few = spread.withColumn("r", F.row_number().over(rank)).where(
        (F.col("df") > 1) & (F.col("r") <= F.col("n") - F.ceil(F.lit(at_least) * F.col("n") - 1e-9) + 1)
    )
    left = few.select("s", F.col("id").alias("id_a"), F.col("n").alias("n_a"), F.col("part").alias("meets"))
    right = few.select(
        "s", F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.explode(F.array("part", F.col("part") - 1)).alias("meets")
    )
    fits = (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") >= at_least * F.col("n_b") - 1e-9)
    pairs = left.join(right, ["s", "meets"]).where(fits & ((F.col("n_a") < F.col("n_b")) | (F.col("id_a") < F.col("id_b"))))
    pairs = pairs.select("id_a", "id_b").distinct()
    sets = classes.select("id", "signs")
    out = pairs.join(sets.toDF("id_a", "a"), "id_a").join(sets.toDF("id_b", "b"), "id_b")
    out = out.withColumn("likeness", likeness(F.col("a"), F.col("b"), at_least)).where(F.col("likeness") >= at_least)
    return out.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "likeness")


def with_next(docs: DataFrame, prepare, columns: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``prepare`` of rows (doc_id, text), with ``next_<column>`` of the row that follows by (doc_id, text),
    the first after the last.

    Ids are cut into blocks of equal width, about ``rows`` rows each where ids are spread evenly. The first
    row of each block is copied to the end of the block before, so one window per block sees all it needs.
    Only these rows, one per block, are looked at across blocks.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) * rows // max(n, 1)))
    block = F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(-1)).cast("long")
    rows_in = docs.select("doc_id", "text", block.alias("_block"))
    firsts = rows_in.groupBy("_block").agg(F.min(F.struct("doc_id", "text")).alias("_first"))
    firsts = materialize(firsts, "firsts")
    last = F.max("_block").over(Window.partitionBy())
    before = F.coalesce(F.lag("_block").over(Window.orderBy("_block")), last)
    places = firsts.select("_block", before.alias("_before"))
    ghosts = firsts.join(places, "_block").select("_first.doc_id", "_first.text", F.col("_before").alias("_block"))
    both = prepare(rows_in).withColumn("_ghost", F.lit(0)).unionByName(prepare(ghosts).withColumn("_ghost", F.lit(1)))
    by = Window.partitionBy("_block").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")
    return (
        both.withColumns({f"next_{c}": F.lead(c).over(by) for c in columns}).where("_ghost = 0").drop("_block", "_ghost")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and both likenesses.

    The edited text has its last quarter replaced by as many code points from the next document's start."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    anchors = common_words(rows)
    rows = with_next(rows, lambda d: d.withColumn("signs", signatures(F.col("text"), anchors)), ["text", "signs"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_signs", signatures(F.col("edited"), anchors))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
