"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Training rows are subsampled per tree by hash rank, each tree is grown in its own small group, and
rows are scored in groups of bounded size that meet a copy of their scope's trees. Scores follow the
convention: negative means more unusual than the contamination share of the training rows.
"""

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fenceline.functions.quantiles import SMALL_DOMAIN, splitter_quantiles
from fenceline.functions.text import fixed
from fenceline.operators.features import REASON_FEATURES
from fenceline.settings import DEFAULTS, DetectionSettings
from fenceline.sources.shared import materialize

# The model's inputs, in order, and the thresholds of its explanations.
FEATURES = ("sold", "delivered", "returned", "delta_on_hand", "price", "promo_flag", "day_of_week")
TOP_REASONS = 3
MIN_REASON_Z = 1.5
EULER_GAMMA = 0.5772156649015329

GLOBAL_SCOPE = "global"
#: Trees of up to this many bytes in all are sent to every task, and rows are scored where they are. Beyond
#: it rows meet a copy of their scope's trees (about one megabyte) in groups of so many rows.
TREE_BYTES = 64_000_000
ROWS_PER_GROUP = 500_000
# Tables with one small row per scope are broadcast while there are at most this many scopes (a few
# megabytes); the rows are then never shuffled by scope. Beyond that adaptive execution joins them.
BROADCAST_SCOPES = 100_000
# A scope's trees are grown in this many groups of at most 256 rows per tree.
TREE_BUNDLES = 10
TREES = (
    "scope string, tree int, sample_size int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


# --- model -------------------------------------------------------------------------------------


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    many = np.maximum(n, 3.0)
    longer = 2.0 * (np.log(many - 1.0) + EULER_GAMMA) - 2.0 * (many - 1.0) / many
    return np.where(n > 2, longer, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, rng: np.random.Generator):
    """Node arrays of one random tree; ``feature`` is -1 at leaves, ``path`` their path length."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    draws = iter(rng.random(4 * len(points)).tolist())  # two per split, fewer splits than points
    feature, threshold, left, right, depths, sizes = [], [], [], [], [], []
    stack = [(points, 0, -1, left)]
    while stack:
        part, depth, parent, side = stack.pop()
        node = len(feature)
        if parent >= 0:
            side[parent] = node
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        depths.append(depth)
        sizes.append(len(part))
        if depth >= limit or len(part) <= 1:
            continue
        low, high = part.min(axis=0), part.max(axis=0)
        usable = (high > low).nonzero()[0]
        if not len(usable):
            continue
        f = int(usable[int(next(draws) * len(usable))])
        cut = float(low[f] + (high[f] - low[f]) * next(draws))
        below = part[:, f] < cut
        feature[node], threshold[node] = f, cut
        stack.append((part[~below], depth + 1, node, right))
        stack.append((part[below], depth + 1, node, left))
    path = (np.array(depths) + average_path(sizes)).tolist()
    return feature, threshold, left, right, path


def score_points(trees: pd.DataFrame, points: np.ndarray) -> np.ndarray:
    """-1 (unusual) to 0 (ordinary), all points at once per tree.

    Leaves lead to themselves, so every point takes the same number of steps.
    """
    sample = int(trees["sample_size"].iloc[0])
    flat = np.ascontiguousarray(points).ravel()
    start = np.arange(len(points)) * points.shape[1]
    total = np.zeros(len(points))
    for t in trees.itertuples():
        feature, cut = np.asarray(t.feature), np.asarray(t.threshold)
        leaf = feature < 0
        own = np.arange(len(feature))
        child = np.column_stack([np.where(leaf, own, t.right), np.where(leaf, own, t.left)]).ravel()
        tested = np.where(leaf, 0, feature)
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(math.ceil(math.log2(max(sample, 2)))):
            below = flat[start + tested[node]] < cut[node]
            node = child[2 * node + below]
        total += np.asarray(t.path)[node]
    scale = float(average_path(sample))
    return -np.exp2(-(total / len(trees)) / scale) if scale > 0 else np.full(len(points), -1.0)


def _per_scope(table: DataFrame, scope_count: int) -> DataFrame:
    return F.broadcast(table) if scope_count <= BROADCAST_SCOPES else table


def fit_forest(
    training: DataFrame, inputs, scope_count: int, settings: DetectionSettings = DEFAULTS
) -> DataFrame:
    """Trees per scope from rows with columns scope, row_key and the inputs.

    A row enters a tree when its hash ranks among the 256 smallest of those that were dealt to the tree.
    How many trees a row is dealt to is binomial: one hash, read through the inverse of its distribution,
    says how many, and only rows with one or more order the trees by further hashes to say which. The share
    leaves somewhat more rows per tree than it needs, so nearly all rows of a large scope are dropped by the
    one hash before anything is shuffled; the rank makes the sample exact, repeatable and independent of
    partitioning.
    """
    size, seed, tree_count = settings.forest_sample, settings.forest_seed, settings.forest_trees
    wanted = size * 1.5 + 64
    counts = training.groupBy("scope").agg(F.count(F.lit(1)).alias("scope_rows"))
    share = F.least(wanted / F.col("scope_rows"), F.lit(1.0))
    numbers = F.sequence(F.lit(0), F.lit(tree_count - 1))

    def draw(tree):
        return F.struct(tree.alias("tree"), F.xxhash64(F.lit(seed), "scope", tree, "row_key").alias("draw"))

    # Uniform in (0, 1); the number of trees is the first k at which the binomial distribution reaches it.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "scope", "row_key"), 11) + 0.5) / float(2**53)
    odds = F.col("share") / (1 - F.col("share"))

    def step(state, k):
        mass = state["mass"] * (tree_count - k) / (k + 1) * odds
        more = F.col("uniform") > state["below"]
        return F.struct(
            (state["k"] + F.when(more, 1).otherwise(0)).alias("k"),
            mass.alias("mass"),
            (state["below"] + mass).alias("below"),
        )

    none = F.pow(1 - F.col("share"), F.lit(float(tree_count)))
    start = F.struct(F.lit(0).alias("k"), none.alias("mass"), none.alias("below"))
    trees_of = (
        F.when(F.col("share") >= 1, tree_count)
        .when(F.col("uniform") <= none, 0)
        .otherwise(F.aggregate(numbers, start, step, lambda state: state["k"]))
    )
    by_hash = F.array_sort(
        F.transform(numbers, lambda t: F.struct(F.xxhash64(F.lit(seed + 2), "scope", t, "row_key").alias("h"), t.alias("t")))
    )
    kept = F.when(
        F.col("dealt") > 0, F.transform(F.slice(by_hash, F.lit(1), F.col("dealt")), lambda d: draw(d["t"]))
    )
    order = Window.partitionBy("scope", "tree").orderBy("draw", "row_key")
    sample = (
        training.join(_per_scope(counts, scope_count), "scope")
        .withColumn("share", share)
        .withColumn("uniform", uniform)
        .withColumn("dealt", trees_of)
        .select("scope", "row_key", *inputs, F.inline(kept))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
    )
    inputs = list(inputs)
    columns = ["scope", "tree", "sample_size", "feature", "threshold", "left", "right", "path"]

    def grow(key, rows):
        scope = key[0]
        grown = []
        for tree, own in rows.sort_values(["tree", "rank"]).groupby("tree"):
            rng = np.random.default_rng([seed, zlib.crc32(scope.encode()), int(tree)])
            grown.append((scope, int(tree), len(own), *grow_tree(own[inputs].to_numpy(dtype=float), rng)))
        return pd.DataFrame(grown, columns=columns)

    bundles = sample.select("scope", "tree", "rank", (F.col("tree") % TREE_BUNDLES).alias("bundle"), *inputs)
    return bundles.groupBy("scope", "bundle").applyInPandas(grow, TREES)


def score_rows(
    rows: DataFrame, trees: DataFrame, inputs, scope_count: int, rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """Add ``score`` to rows with columns scope, row_key and the inputs.

    Trees within TREE_BYTES go to every task and no row is shuffled. Otherwise a scope's rows are dealt by
    hash into groups of about ``rows_per_group``, and its trees are copied to each group, so no scope is
    gathered whole in one task. ``trees`` is stored; both ways give the same scores.
    """
    inputs = list(inputs)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    columns = [*rows.columns, "score"]
    # A node takes 28 bytes in the five arrays.
    size = trees.agg(F.coalesce(F.sum(28 * F.size("feature") + 64), F.lit(0))).first()[0]
    if size <= TREE_BYTES:
        models = trees.toPandas()  # TREE_BYTES at most
        by_scope = {scope: model.sort_values("tree") for scope, model in models.groupby("scope")}
        sent = rows.sparkSession.sparkContext.broadcast(by_scope)

        def score_here(batches):
            for batch in batches:
                scores = np.full(len(batch), np.nan)
                for scope, at in batch.groupby("scope").indices.items():
                    if scope in sent.value:
                        scores[at] = score_points(sent.value[scope], batch[inputs].to_numpy(dtype=float)[at])
                out = batch.assign(score=scores)
                yield out[~np.isnan(scores)][columns]

        return rows.mapInPandas(score_here, schema)
    parts = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / rows_per_group).cast("int").alias("parts"))
    parts = _per_scope(parts, scope_count)
    part = F.pmod(F.xxhash64("row_key"), F.col("parts")).cast("int")
    dealt = rows.join(parts, "scope").withColumn("part", part).drop("parts")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    copies = trees.join(parts, "scope").withColumn("part", every).drop("parts")

    def score(group, model):
        if group.empty or model.empty:
            return pd.DataFrame(columns=columns)
        points = group[inputs].to_numpy(dtype=float)
        return group.assign(score=score_points(model.sort_values("tree"), points))[columns]

    return dealt.groupBy("scope", "part").cogroup(copies.groupBy("scope", "part")).applyInPandas(score, schema)


def offsets(scored_training: DataFrame, contamination: float, most: int = SMALL_DOMAIN) -> DataFrame:
    """Per scope, the score below which the contamination share of the training rows lies.

    Never more than ``most`` distinct scores are ordered in one piece, however large a scope is.
    """
    hist = materialize(scored_training.groupBy("scope", "score").agg(F.count(F.lit(1)).alias("w")), "scores")
    return splitter_quantiles(hist, ["scope"], "score", "w", (contamination,), ("offset",), most).drop("n")


def _scored(rows: DataFrame, training: DataFrame, trees: DataFrame, inputs, scope_count, settings) -> DataFrame:
    """Rows with ``anomaly_score`` (score minus the scope's offset) and ``is_anomaly``."""
    both = rows.withColumn("in_training", F.lit(False)).unionByName(
        training.withColumn("in_training", F.lit(True)), allowMissingColumns=True
    )
    scored = materialize(score_rows(both, trees, inputs, scope_count), "forest-scores")
    trained = scored.filter("in_training")
    limits = offsets(trained, settings.contamination)
    return (
        scored.filter("not in_training")
        .join(_per_scope(limits, scope_count), "scope")
        .withColumn("anomaly_score", F.col("score") - F.col("offset"))
        .withColumn("is_anomaly", F.col("anomaly_score") < 0)
        .drop("in_training", "score", "offset", "scope_rows")
    )


# --- daily rows ----------------------------------------------------------------------------------


def forest_features(features: DataFrame) -> DataFrame:
    """The seven model inputs as doubles, missing ones 0."""
    return features.select(
        "date",
        "day_number",
        "store_id",
        "sku_id",
        *[F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in FEATURES],
    )


def training_counts(features: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """Per scope and day with rows: how many rows lie in the training span before it.

    Rows are counted per (scope, day) first, so each window group is bounded by the calendar.
    """
    scopes = F.array(F.concat(F.lit("store:"), "store_id"), F.lit(GLOBAL_SCOPE))
    per_day = (
        features.select(F.explode(scopes).alias("scope"), "day_number")
        .groupBy("scope", "day_number")
        .agg(F.count(F.lit(1)).alias("day_rows"))
    )
    span = (
        Window.partitionBy("scope").orderBy("day_number").rangeBetween(-settings.forest_window_days, -1)
    )
    return per_day.withColumn("training_rows", F.coalesce(F.sum("day_rows").over(span), F.lit(0)))


def cutoffs(features: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """First day on which each scope has enough training rows."""
    enough = training_counts(features, settings).filter(F.col("training_rows") >= settings.forest_min_rows)
    return enough.groupBy("scope").agg(F.min("day_number").alias("cutoff"))


def with_scope(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``scope``: the store's model from its cutoff on, else the global one, else NULL.

    ``cuts`` is stored; the global cutoff is a single day.
    """
    stores = cuts.filter(F.col("scope") != GLOBAL_SCOPE).select(
        F.substring_index("scope", "store:", -1).alias("store_id"), F.col("cutoff").alias("store_cutoff")
    )
    everybody = cuts.filter(F.col("scope") == GLOBAL_SCOPE).first()  # one day, or none
    global_cutoff = F.lit(everybody["cutoff"] if everybody else None).cast("int")
    day = F.col("day_number")
    scope = F.when(day >= F.col("store_cutoff"), F.concat(F.lit("store:"), "store_id")).when(
        day >= global_cutoff, F.lit(GLOBAL_SCOPE)
    )
    return rows.join(stores, "store_id", "left").withColumn("scope", scope).drop("store_cutoff")


def training_rows(inputs: DataFrame, cuts: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """Rows in the training span of their store's model or of the global one.

    ``cuts`` is stored. Its first and last day bound the rows that can train anything, so the scan
    skips the rest; only the rows left are joined to their store's cutoff. The global span is a
    literal range.
    """
    span = settings.forest_window_days
    is_global = F.col("scope") == GLOBAL_SCOPE
    ends = cuts.agg(
        F.min(F.when(~is_global, F.col("cutoff"))).alias("first"),
        F.max(F.when(~is_global, F.col("cutoff"))).alias("last"),
        F.max(F.when(is_global, F.col("cutoff"))).alias("everybody"),
    ).first()

    def days(low, high):
        return inputs.filter(F.col("day_number").between(low - span, high - 1) if low is not None else F.lit(False))

    inside = F.col("day_number").between(F.col("cutoff") - span, F.col("cutoff") - 1)
    stores = (
        days(ends["first"], ends["last"])
        .withColumn("scope", F.concat(F.lit("store:"), "store_id"))
        .join(cuts.filter(~is_global), "scope")
        .filter(inside)
    )
    everybody = days(ends["everybody"], ends["everybody"]).withColumn("scope", F.lit(GLOBAL_SCOPE))
    wanted = ["scope", row_key().alias("row_key"), *FEATURES]
    return stores.select(*wanted).unionByName(everybody.select(*wanted))


def row_key():
    return F.concat_ws("|", F.col("day_number").cast("string"), "store_id", "sku_id")


def z_scores(baseline: DataFrame) -> list:
    """Per reason feature: struct(feature, value, mean, z), z 0 where the deviation is 0."""
    out = []
    for name in REASON_FEATURES:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        z = F.when(F.col(f"{name}_std") > 0, (value - F.col(f"{name}_mean")) / F.col(f"{name}_std")).otherwise(0.0)
        out.append(
            F.struct(F.lit(name).alias("feature"), value.alias("value"), F.col(f"{name}_mean").alias("mean"), z.alias("z"))
        )
    return out


def notable_z(baseline: DataFrame):
    """Array of the up to three features with the largest absolute z above 1.5, largest first.

    Absolute values are compared at nine decimals, so that equal ones stay equal on every engine.
    """
    ranked = [
        F.struct((-F.round(F.abs(s["z"]), 9)).alias("a"), F.lit(i).alias("i"), s.alias("s"))
        for i, s in enumerate(z_scores(baseline))
    ]
    top = F.filter(F.slice(F.array_sort(F.array(*ranked)), 1, TOP_REASONS), lambda e: -e["a"] > MIN_REASON_Z)
    found = F.transform(top, lambda e: e["s"])
    return F.when(F.col("baseline_rows") > 0, found).otherwise(F.slice(found, 1, 0))


def forest_reasons(baseline: DataFrame) -> DataFrame:
    """Add ``reasons``: the notable features in words; empty without any history."""
    told = F.transform(
        notable_z(baseline),
        lambda s: F.struct(
            s["feature"].alias("feature"),
            F.bround(s["z"], 2).alias("z_score"),
            F.concat(
                s["feature"],
                F.lit(" is "),
                fixed(F.abs(s["z"]), 1),
                F.when(s["z"] > 0, F.lit(" std above average")).otherwise(F.lit(" std below average")),
            ).alias("message"),
            s["value"].alias("value"),
            F.bround(s["mean"], 2).alias("mean"),
        ),
    )
    return baseline.withColumn("reasons", told)


def forest_results(baseline: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """Score, flag and reasons for every daily row.

    ``baseline`` is the output of ``feature_baseline``, stored, since several steps read it. Means and
    deviations travel through scoring as plain doubles, and reasons are written afterwards, so no
    join by row is needed.
    """
    cuts = materialize(cutoffs(baseline, settings), "forest-cutoffs")
    inputs = forest_features(baseline)
    scope_count = cuts.count()
    training = training_rows(inputs, cuts, settings)
    trees = materialize(fit_forest(training, FEATURES, scope_count, settings), "forest-trees")

    carried = [f"{name}_{stat}" for name in REASON_FEATURES for stat in ("mean", "std")]
    rows = with_scope(
        baseline.select(
            "day_number",
            "store_id",
            "sku_id",
            F.col("baseline_rows").cast("bigint").alias("baseline_rows"),
            *[F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name) for name in FEATURES],
            *carried,
        ),
        cuts,
    ).withColumn("row_key", row_key())
    scored = _scored(rows.filter("scope is not null"), training, trees, FEATURES, scope_count, settings)
    unscored = (
        rows.filter("scope is null")
        .withColumn("anomaly_score", F.lit(0.0))
        .withColumn("is_anomaly", F.lit(False))
    )
    told = forest_reasons(scored.unionByName(unscored))
    label = F.when(F.col("scope").isNull(), "insufficient_data").when(F.col("scope") == GLOBAL_SCOPE, "global")
    return told.select(
        F.date_from_unix_date("day_number").alias("date"),
        "store_id",
        "sku_id",
        "anomaly_score",
        "is_anomaly",
        F.lit(settings.contamination).alias("threshold_used"),
        F.when(F.col("scope").isNotNull(), F.col("reasons")).otherwise(F.slice("reasons", 1, 0)).alias("reasons"),
        label.alias("fallback_used"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows round-robin where a scan has fewer partitions than there are cores (a small or unsplittable input), so
    that scoring, which is work for the processor, does not run in a few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def single_scope_scores(
    rows: DataFrame, inputs, row_count: int, settings: DetectionSettings = DEFAULTS
) -> DataFrame:
    """One model for the whole table: fit on all rows, then score and flag the same rows."""
    scoped = rows.withColumn("scope", F.lit(GLOBAL_SCOPE))
    training = scoped.select("scope", "row_key", *inputs)
    trees = materialize(fit_forest(training, inputs, 1, settings), "forest-trees")
    scored = materialize(score_rows(spread(scoped), trees, inputs, 1), "forest-scores")
    limit = offsets(scored, settings.contamination)
    return (
        scored.join(F.broadcast(limit), "scope")  # one row
        .withColumn("anomaly_score", F.col("score") - F.col("offset"))
        .withColumn("is_anomaly", F.col("anomaly_score") < 0)
        .drop("score", "offset", "scope")
    )
