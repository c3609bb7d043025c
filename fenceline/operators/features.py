"""Daily features and rolling baselines of one (store, SKU) pair."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.settings import DEFAULTS, DetectionSettings

# The features that reasons name, and the rows a pair needs for a baseline of its own.
REASON_FEATURES = ("sold", "delivered", "returned", "delta_on_hand", "price")
MIN_PAIR_ROWS = 5


def _pair_history(settings: DetectionSettings):
    pair = Window.partitionBy("store_id", "sku_id").orderBy("day_number")
    return pair, pair.rangeBetween(-settings.window_days, -1)


def daily_features(raw: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """Raw columns plus change since the previous row, weekday (Monday = 0) and rolling statistics.

    One shuffle on (store, SKU). A pair has one row per calendar day, so a partition group and
    each 28-day frame are bounded by the calendar, not by the data volume.
    """
    pair, recent = _pair_history(settings)
    # One select, so that every frame shares one Window node and one sort.
    framed = raw.withColumn("day_number", F.unix_date("date")).select(
        "*",
        F.lag("day_number").over(pair).alias("prev_day_number"),
        F.lag("on_hand").over(pair).alias("prev_on_hand"),
        F.avg("sold").over(recent).alias("sold_rolling_mean"),
        F.stddev_pop("sold").over(recent).alias("sold_rolling_std"),
        F.avg("on_hand").over(recent).alias("on_hand_rolling_mean"),
        F.stddev_pop("on_hand").over(recent).alias("on_hand_rolling_std"),
    )
    change = F.col("on_hand").cast("bigint") - F.col("prev_on_hand").cast("bigint")
    return (
        framed.withColumn("delta_on_hand", change)
        .withColumn("day_of_week", F.weekday("date"))
        .drop("prev_on_hand")
    )


def feature_baseline(features: DataFrame, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """Mean and population std of the reason features over the window before each row.

    The pair's own rows count when there are at least five; otherwise the whole store's rows. The
    store side works on per-day moments, merged over at most 28 days, so no raw row is repeated.
    ``baseline_rows`` is 0 where neither level has history.
    """
    _, recent = _pair_history(settings)
    rows = features.select(
        "*",
        F.count(F.lit(1)).over(recent).alias("pair_rows"),
        *[F.count(name).over(recent).alias(f"{name}_pair_n") for name in REASON_FEATURES],
        *[F.avg(name).over(recent).alias(f"{name}_pair_mean") for name in REASON_FEATURES],
        *[F.stddev_pop(name).over(recent).alias(f"{name}_pair_std") for name in REASON_FEATURES],
    )
    store = _store_baseline(features, settings)
    joined = rows.join(store, ["store_id", "day_number"], "left")
    use_pair = F.col("pair_rows") >= MIN_PAIR_ROWS
    rows_used = F.when(use_pair, F.col("pair_rows")).otherwise(F.coalesce("store_rows", F.lit(0)))
    known = rows_used > 0

    def chosen(name, stat):
        return F.when(use_pair, F.col(f"{name}_pair_{stat}")).otherwise(F.col(f"{name}_store_{stat}"))

    stats = []
    for name in REASON_FEATURES:
        n = F.coalesce(chosen(name, "n"), F.lit(0))
        stats.append(F.when(known & (n > 0), chosen(name, "mean")).when(known, 0.0).alias(f"{name}_mean"))
        stats.append(F.when(known & (n > 1), chosen(name, "std")).when(known, 1.0).alias(f"{name}_std"))
    return joined.select(*features.columns, rows_used.alias("baseline_rows"), *stats)


def _store_baseline(features: DataFrame, settings: DetectionSettings) -> DataFrame:
    """Per (store, day): moments of the store's rows in the window before that day."""
    per_day = features.groupBy("store_id", "day_number").agg(
        F.count(F.lit(1)).alias("day_rows"),
        *[
            F.struct(
                F.count(name).alias("n"),
                F.coalesce(F.avg(name), F.lit(0.0)).alias("mean"),
                (F.coalesce(F.var_pop(name), F.lit(0.0)) * F.count(name)).alias("m2"),
            ).alias(name)
            for name in REASON_FEATURES
        ],
    )
    recent = (
        Window.partitionBy("store_id").orderBy("day_number").rangeBetween(-settings.window_days, -1)
    )
    seen = per_day.select(
        "store_id",
        "day_number",
        F.sum("day_rows").over(recent).alias("store_rows"),
        *[F.sum(F.col(name)["n"]).over(recent).alias(f"{name}_store_n") for name in REASON_FEATURES],
        *[F.sum(F.col(name)["n"] * F.col(name)["mean"]).over(recent).alias(f"{name}_sum") for name in REASON_FEATURES],
        *[F.sum(F.col(name)["m2"]).over(recent).alias(f"{name}_m2") for name in REASON_FEATURES],
        *[F.collect_list(name).over(recent).alias(name) for name in REASON_FEATURES],
    )
    means = seen.select(
        "*", *[F.try_divide(f"{name}_sum", f"{name}_store_n").alias(f"{name}_store_mean") for name in REASON_FEATURES]
    )

    def spread(name):
        centre = F.col(f"{name}_store_mean")
        between = F.aggregate(
            name, F.lit(0.0), lambda acc, d: acc + d["n"] * (d["mean"] - centre) * (d["mean"] - centre)
        )
        return F.sqrt(F.try_divide(F.col(f"{name}_m2") + between, F.col(f"{name}_store_n")))

    return means.select(
        "store_id",
        "day_number",
        "store_rows",
        *[f"{name}_store_n" for name in REASON_FEATURES],
        *[f"{name}_store_mean" for name in REASON_FEATURES],
        *[spread(name).alias(f"{name}_store_std") for name in REASON_FEATURES],
    )
