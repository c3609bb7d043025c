"""Exact quantiles (linear interpolation) that hold up on very large and very skewed groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize

#: Distinct values that are ordered in one piece; values sampled to find splitters.
SMALL_DOMAIN = 1_000_000
SAMPLE = 4096
#: Blocks of values that one step of a descent tells apart.
FAN_OUT = 256


def interpolate(low: Column, high: Column, fraction: Column) -> Column:
    """Between two neighbours, measured from the nearer one."""
    step = high - low
    return F.when(fraction < 0.5, low + step * fraction).otherwise(high - step * (1 - fraction))


def array_quantile(ordered: Column, p: float) -> Column:
    """Quantile of a sorted array; NULL for an empty one."""
    position = (F.size(ordered) - 1) * F.lit(p)
    below = F.floor(position).cast("int")
    low = F.get(ordered, below)
    high = F.get(ordered, F.least(below + 1, F.size(ordered) - 1))
    return interpolate(low, high, position - below)


def _from_ranks(n: Column, probabilities, value_at) -> list[Column]:
    """One quantile per probability, given ``value_at(i, side)`` for its two neighbours."""
    out = []
    for i, p in enumerate(probabilities):
        position = (n - 1) * F.lit(p)
        fraction = position - F.floor(position)
        out.append(interpolate(value_at(i, "low"), value_at(i, "high"), fraction))
    return out


def _rank(n: Column, p: float, side: str) -> Column:
    """0-based rank of the neighbour of quantile ``p`` in a group of ``n``."""
    below = F.floor((n - 1) * F.lit(p))
    return below if side == "low" else F.least(below + 1, n - 1)


def histogram_quantiles(
    hist: DataFrame, keys: list[str], value: str, weight: str, probabilities, names, block: float | None = None
) -> DataFrame:
    """Quantiles per group of a (value, weight) histogram with one row per distinct value.

    Columns out: keys, ``n`` and one column per name. The running count goes through one group per
    key, so the group is as long as its number of distinct values. Where that can be large, ``block``
    cuts the value range into blocks of that width: the ranks are first located among the blocks,
    and only the blocks hit are opened and ordered inside.
    """
    if block:
        hist = _blocks_hit(hist, keys, value, weight, probabilities, block)
    else:
        everything = Window.partitionBy(*keys)
        hist = hist.withColumn("__n", F.sum(weight).over(everything)).withColumn("__before", F.lit(0))
    group = keys + (["__block"] if block else [])
    running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("__upto", F.sum(weight).over(running) + F.col("__before"))

    def at(i, side):
        rank = _rank(F.col("__n"), probabilities[i], side)
        covers = (F.col("__upto") > rank) & (F.col("__upto") - F.col(weight) <= rank)
        return F.max(F.when(covers, F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        *[at(i, side).alias(f"__{side}{i}") for i in range(len(probabilities)) for side in ("low", "high")],
    )
    found = _from_ranks(F.col("n"), probabilities, lambda i, side: F.col(f"__{side}{i}").cast("double"))
    return picked.select(*keys, F.col("n"), *[q.alias(name) for q, name in zip(found, names)])


def _blocks_hit(hist, keys, value, weight, probabilities, block) -> DataFrame:
    """Histogram rows in the value blocks that hold a wanted rank, with the count before the block."""
    blocked = hist.withColumn("__block", F.floor(F.col(value) / block))
    blocks = blocked.groupBy(*keys, "__block").agg(F.sum(weight).alias("__w"))
    running = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("__end", F.sum("__w").over(running)).withColumn(
        "__n", F.sum("__w").over(Window.partitionBy(*keys))
    )
    start = F.col("__end") - F.col("__w")
    hit = F.lit(False)
    for p in probabilities:
        for side in ("low", "high"):
            rank = _rank(F.col("__n"), p, side)
            hit = hit | ((start <= rank) & (rank < F.col("__end")))
    chosen = blocks.filter(hit).select(*keys, "__block", "__n", start.alias("__before"))
    return blocked.join(chosen, [*keys, "__block"])


def splitter_quantiles(
    hist: DataFrame, keys: list[str], value: str, weight: str, probabilities, names, most: int = SMALL_DOMAIN, sample: int = SAMPLE
) -> DataFrame:
    """Quantiles per group of a stored (value, weight) histogram with one row per distinct value, however many.

    Columns out: keys, ``n`` and one column per name. For every wanted rank there is a bracket of values that holds it.
    While a bracket has more than ``most`` distinct values, about ``sample`` of them, picked by hash, give two splitters
    around the place where the rank is expected; what lies below, between and above them is counted exactly, and
    the part that holds the rank is the next bracket. Every other round takes the sample's middle value for both, so
    that brackets shrink even where one value has most of the weight. Then only brackets are ordered, so no window ever has more than
    ``most`` rows. Brackets are rows of a table; the driver only sees the size of the largest.
    """
    totals = hist.groupBy(*keys).agg(
        F.sum(weight).alias("__n"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__d")
    )
    ranks = [
        F.struct(F.lit(f"{side}{i}").alias("__which"), _rank(F.col("__n"), p, side).cast("bigint").alias("__rank"))
        for i, p in enumerate(probabilities)
        for side in ("low", "high")
    ]
    columns = [*keys, "__n", "__which", "__rank", "__w", "__lo", "__hi", "__d"]
    open_ = totals.withColumn("__w", F.col("__n")).select("*", F.inline(F.array(*ranks))).select(*columns)
    open_, seed = materialize(open_, "brackets"), 0
    while (open_.agg(F.coalesce(F.max("__d"), F.lit(0))).first()[0]) > most:
        seed += 1
        narrow, wide = open_.filter(F.col("__d") <= most), open_.filter(F.col("__d") > most)
        open_ = materialize(narrow.unionByName(_split(hist, wide, keys, value, weight, sample, seed).select(*columns)), "brackets")
    running = Window.partitionBy(*keys, "__which").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = hist.join(open_, keys).filter(F.col(value).between(F.col("__lo"), F.col("__hi")))
    upto = F.col("__upto")
    last = held.withColumn("__upto", F.sum(weight).over(running)).filter(
        (upto > F.col("__rank")) & (upto - F.col(weight) <= F.col("__rank"))
    )
    labels = [f"{side}{i}" for i in range(len(probabilities)) for side in ("low", "high")]
    picked = last.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        *[F.max(F.when(F.col("__which") == label, F.col(value))).cast("double").alias(f"__{label}") for label in labels],
    )
    found = _from_ranks(F.col("n"), probabilities, lambda i, side: F.col(f"__{side}{i}"))
    return picked.select(*keys, "n", *[q.alias(name) for q, name in zip(found, names)])


def _split(hist, wide, keys, value, weight, sample, seed) -> DataFrame:
    """The parts of wide brackets that hold their ranks."""
    group = [*keys, "__which"]
    inside = hist.join(wide, keys).filter(F.col(value).between(F.col("__lo"), F.col("__hi")))
    every = F.greatest(F.ceil(F.col("__d") / sample), F.lit(1))
    picked = inside.filter(F.pmod(F.xxhash64(F.lit(seed), value), every) == 0)
    ordered = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    # Where a value lies in the sample, as a share of its weight, against where the rank lies in the bracket.
    place = F.sum(weight).over(ordered) / F.sum(weight).over(whole)
    wanted, margin = F.col("__rank") / F.col("__w"), 3 / sample**0.5
    if seed % 2:
        placed = picked.withColumn("__place", place).withColumn("__wanted", wanted)
        splitters = placed.groupBy(*group).agg(
            F.max(F.when(F.col("__place") <= F.col("__wanted") - margin, F.col(value))).alias("__a"),
            F.min(F.when(F.col("__place") >= F.col("__wanted") + margin, F.col(value))).alias("__b"),
        )
    else:
        middle = F.sort_array(F.collect_list(value))  # about ``sample`` values
        middle = F.get(middle, F.floor(F.size(middle) / 2).cast("int"))
        splitters = picked.groupBy(*group).agg(middle.alias("__a")).withColumn("__b", F.col("__a"))
    cut = wide.join(splitters, group, "left").withColumns(
        {"__a": F.coalesce("__a", "__lo"), "__b": F.coalesce("__b", "__hi")}
    )
    v = F.col(value)
    part = F.when(v < F.col("__a"), 0).when(v <= F.col("__b"), 1).otherwise(2)
    within = hist.join(cut, keys).filter(v.between(F.col("__lo"), F.col("__hi"))).withColumn("__part", part)
    counts = within.groupBy(*group, "__n", "__rank", "__part").agg(
        F.sum(weight).alias("__w"), F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(F.lit(1)).alias("__d")
    )
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__w").over(before), F.lit(0)))
    rank = F.col("__rank") - F.col("__before")
    return counts.filter((rank >= 0) & (rank < F.col("__w"))).withColumn("__rank", rank)


def running_quantiles(
    changes: DataFrame, wanted: DataFrame, keys: list[str], value: str, probabilities, names, fan_out: int = FAN_OUT
) -> DataFrame:
    """Quantiles of the whole numbers that are current at wanted places of an order, a rolling window for instance.

    ``changes`` (keys, value, at, change) tells how many of a value come, or go where negative, at a place. ``wanted`` (keys, at, n)
    names each place once, with the number of values current there; places where n is 0 are left out. Both are stored tables
    or cheap to make from such, as they are read more than once.
    Columns out: keys, ``at`` and one column per name.

    No value is repeated for the places that see it. The range of values is cut into at most ``fan_out`` blocks (a power of two), the
    changes of a block are summed per place, and their running sum is the block's size at every place. The running sum over blocks
    tells which of them holds a wanted rank, and the next step cuts only those, down to single values. A window is as long as a
    key has places, or ``fan_out`` rows. The driver sees the smallest and the largest value.
    """
    bits = fan_out.bit_length() - 1
    low, high = changes.agg(F.min(value), F.max(value)).first()
    top = 0
    while low is not None and (high >> bits * top) - (low >> bits * top) >= fan_out:
        top += 1
    ranks = F.array(
        *[
            F.struct(F.lit(f"{side}{i}").alias("which"), _rank(F.col("n"), p, side).cast("bigint").alias("rank"))
            for i, p in enumerate(probabilities)
            for side in ("low", "high")
        ]
    )
    place, within = [*keys, "at"], [*keys, "__parent"]
    open_ = wanted.filter("n > 0").select(*place, "n", F.lit(0).cast("bigint").alias("__parent"), ranks.alias("__ranks"))
    for step in range(top, -1, -1):
        block = F.shiftright(F.col(value).cast("bigint"), bits * step)
        parent = F.shiftright(block, bits) if step < top else F.lit(0).cast("bigint")
        moved = changes.select(*place, parent.alias("__parent"), block.alias("__block"), "change")
        moved = moved.join(open_.select(*within).distinct(), within, "left_semi")
        moved = moved.groupBy(*within, "__block", "at").agg(F.sum("change").alias("change"))
        marks = open_.join(moved.select(*within, "__block").distinct(), within).withColumn("change", F.lit(0).cast("bigint"))
        upto_here = Window.partitionBy(*within, "__block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        sizes = (
            moved.unionByName(marks, allowMissingColumns=True)
            .withColumn("__size", F.sum("change").over(upto_here))
            .filter("__ranks is not null and __size > 0")
        )
        over_blocks = Window.partitionBy(*place, "__parent").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
        sizes = sizes.withColumn("__end", F.sum("__size").over(over_blocks)).withColumn("__start", F.expr("__end - __size"))
        inside = F.expr(
            "transform(filter(__ranks, r -> r.rank >= __start and r.rank < __end),"
            " r -> struct(r.which as which, r.rank - __start as rank))"
        )
        hit = sizes.select(*place, "n", F.col("__block").alias("__parent"), inside.alias("__ranks")).filter("size(__ranks) > 0")
        open_ = materialize(hit, "places") if step else hit
    labels = [f"{side}{i}" for i in range(len(probabilities)) for side in ("low", "high")]
    picked = open_.groupBy(*place).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.array_contains("__ranks.which", label), F.col("__parent"))).cast("double").alias(f"__{label}") for label in labels],
    )
    found = _from_ranks(F.col("n"), probabilities, lambda i, side: F.col(f"__{side}{i}"))
    return picked.select(*place, *[q.alias(name) for q, name in zip(found, names)])


def exact_quantiles(
    df: DataFrame, key: str, value: str, probabilities, names, small_domain: int = SMALL_DOMAIN
) -> DataFrame:
    """Exact quantiles of a double column for a few large groups (one per metric, say).

    Equal values are counted before anything is ordered, so a value that fills a third of the table is one row;
    ``small_domain`` is the most distinct values that are ordered in one piece.
    """
    present = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None))).filter(F.col(value).isNotNull())
    hist = present.groupBy(key, value).agg(F.count(F.lit(1)).alias("__weight"))
    return splitter_quantiles(materialize(hist, "values"), [key], value, "__weight", probabilities, names, small_domain)
