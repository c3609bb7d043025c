"""Roll flagged rows up into scored, deduplicated incidents."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.text import fixed, short_hash

ROW = ["date", "store_id", "sku_id"]
GROUP = ["date", "store_id"]
# List lengths in a description.
DESCRIBED_SKUS = 5
DESCRIBED_FOREST_REASONS = 2


def flagged_rows(detections: DataFrame, features: DataFrame) -> DataFrame:
    """One row per (date, store, SKU) that any detector flagged, with its impact estimate.

    Only flagged detections are shuffled; the features are joined by key to that small side.
    """
    tukey = F.col("detector_type") == "tukey"
    forest = F.col("detector_type") == "isolation_forest"
    distance = F.col("outlier_distance")
    flagged = (
        detections.filter("is_outlier")
        .groupBy(*ROW)
        .agg(
            F.max(F.when(tukey & (F.col("metric_name") == "sold"), distance)).alias("sold_distance"),
            F.max(F.when(tukey & (F.col("metric_name") == "delta_on_hand"), distance)).alias("delta_distance"),
            F.bool_or(tukey).alias("by_tukey"),
            F.bool_or(forest).alias("by_forest"),
            F.max(F.when(forest, F.col("reasons"))).alias("forest_reasons"),
        )
    )
    price = F.coalesce("price", F.lit(0.0))
    sold, delta = F.coalesce("sold", F.lit(0)), F.coalesce("delta_on_hand", F.lit(0))
    impact = F.greatest(F.abs(sold * price), F.abs(delta * price))
    values = features.select(*ROW, impact.alias("impact"))

    def near(column):
        return F.when(F.col(column).isNotNull(), F.least(F.abs(column) / 50, F.lit(1.0))).otherwise(0.0)

    def one(column):
        return F.when(F.col(column).isNotNull(), 1).otherwise(0)

    return flagged.join(values, ROW, "left").select(
        *flagged.columns,
        F.coalesce("impact", F.lit(0.0)).alias("impact"),
        (near("sold_distance") + near("delta_distance")).alias("closeness"),
        (one("sold_distance") + one("delta_distance")).alias("tukey_flags"),
    )


def severity(detectors: Column, skus: Column, impact: Column, closeness: Column) -> Column:
    """0 to 100 from detector count, SKU count, log impact and mean closeness (NULL counts as 0)."""
    score = (
        detectors * 20
        + F.least(skus * 5, F.lit(20))
        + F.when(impact > 0, F.least(F.log10(impact + 1) * 5, F.lit(30.0))).otherwise(0.0)
        + F.coalesce(closeness, F.lit(0.0)) * 10
    )
    return F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))


def detector_list(by_tukey: Column, by_forest: Column) -> Column:
    """Names of the detectors that triggered, in alphabetical order."""
    return F.filter(
        F.array(F.when(by_forest, F.lit("isolation_forest")), F.when(by_tukey, F.lit("tukey"))),
        lambda name: name.isNotNull(),
    )


def sku_digest(sku: Column) -> Column:
    """A set of SKUs as one number that map tasks can combine in any order: 60 hash bits each, by XOR."""
    return F.bit_xor(F.conv(F.left(F.sha2(sku, 256), F.lit(15)), 16, 10).cast("bigint"))


def dedup_key(date: Column, store: Column, skus: Column, digest: Column) -> Column:
    """Hash of the week's Monday, the store and all its SKUs, as their number and digest."""
    week = F.date_format(F.trunc(date, "WEEK"), "yyyy-MM-dd")
    return short_hash(F.concat_ws("_", week, store, skus.cast("string"), digest.cast("string")))


def _first_headline() -> Column:
    sku = F.col("sku_id")
    return (
        F.when(F.col("sold_distance").isNotNull(), F.concat(F.lit("Unusual sales for "), sku))
        .when(F.col("delta_distance").isNotNull(), F.concat(F.lit("Inventory anomaly for "), sku))
        .when(
            F.size("forest_reasons") > 0,
            F.concat(F.get("forest_reasons", F.lit(0))["feature"], F.lit(" anomaly for "), sku),
        )
        .otherwise(F.concat(F.lit("Anomaly detected for "), sku))
    )


def _line() -> Column:
    """Description line of one SKU; NULL when there is nothing to say."""

    def out_of_range(metric, column):
        side = F.when(F.col(column) > 0, F.lit(" above normal range")).otherwise(F.lit(" below normal range"))
        return F.concat(F.lit(f"{metric} "), fixed(F.abs(column), 1), side)

    tukey = F.array(out_of_range("sold", "sold_distance"), out_of_range("delta_on_hand", "delta_distance"))
    told = F.transform(F.slice("forest_reasons", 1, DESCRIBED_FOREST_REASONS), lambda r: r["message"])
    parts = F.filter(
        F.concat(tukey, F.coalesce(told, F.array().cast("array<string>"))), lambda part: part.isNotNull()
    )
    return F.when(
        F.size(parts) > 0, F.concat(F.lit("• "), F.col("sku_id"), F.lit(": "), F.array_join(parts, "; "))
    )


def incident_groups(flagged: DataFrame) -> DataFrame:
    """One row per (date, store): score, headline, description and dedup key.

    Totals and the digest of all SKUs use partial aggregation. The description names only the first SKUs,
    which are cut per map task before the shuffle (row_number with a limit), so no store-day is ever
    gathered whole.
    """
    totals = flagged.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("sku_count"),
        sku_digest(F.col("sku_id")).alias("sku_digest"),
        F.sum("impact").alias("estimated_impact"),
        F.bool_or("by_tukey").alias("by_tukey"),
        F.bool_or("by_forest").alias("by_forest"),
        F.try_divide(F.sum("closeness"), F.sum("tukey_flags")).alias("closeness"),
    )
    order = Window.partitionBy(*GROUP).orderBy("sku_id")
    first = (
        flagged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= DESCRIBED_SKUS)
        .select(*GROUP, "rank", "sku_id", _first_headline().alias("headline"), _line().alias("line"))
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "sku_id", "headline", "line"))).alias("first"))
    )
    lines = F.filter(
        F.transform("first", lambda s: s["line"]), lambda line: line.isNotNull()
    )
    more = F.when(
        F.col("sku_count") > DESCRIBED_SKUS,
        F.array(F.concat(F.lit("• ...and "), F.col("sku_count") - DESCRIBED_SKUS, F.lit(" more SKUs"))),
    ).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(lines, more), "\n")
    detectors = detector_list(F.col("by_tukey"), F.col("by_forest"))
    many = F.concat(F.col("sku_count"), F.lit(" SKUs with anomalies in store "), F.col("store_id"))
    return totals.join(first, GROUP).select(
        *GROUP,
        "sku_count",
        "estimated_impact",
        detectors.alias("detectors_triggered"),
        severity(
            F.size(detectors), F.col("sku_count"), F.col("estimated_impact"), F.col("closeness")
        ).alias("severity_score"),
        F.when(F.col("sku_count") == 1, F.get("first", F.lit(0))["headline"]).otherwise(many).alias("headline"),
        F.when(text == "", F.lit("Multiple anomalies detected")).otherwise(text).alias("description"),
        dedup_key(F.col("date"), F.col("store_id"), F.col("sku_count"), F.col("sku_digest")).alias("dedup_key"),
    )


def run_incidents(groups: DataFrame) -> DataFrame:
    """One row per dedup key: the earliest group describes it, the latest one scores it.

    ``first_*`` keep what the creating group had, for its items and its note; ``groups`` counts how
    many groups share the key (at most the seven days of one store's week).
    """
    latest = ["severity_score", "estimated_impact", "sku_count", "detectors_triggered"]
    return groups.groupBy("dedup_key").agg(
        F.min("date").alias("date"),
        F.first("store_id").alias("store_id"),
        F.min_by("headline", "date").alias("headline"),
        F.min_by("description", "date").alias("description"),
        *[F.max_by(c, "date").alias(c) for c in latest],
        F.min_by("estimated_impact", "date").alias("first_impact"),
        F.min_by("detectors_triggered", "date").alias("first_detectors"),
        F.count(F.lit(1)).alias("groups"),
    )


INCIDENT_COLUMNS = {
    "incident_id": "string",
    "date": "date",
    "store_id": "string",
    "dataset_id": "bigint",
    "status": "string",
    "severity_score": "double",
    "headline": "string",
    "description": "string",
    "sku_count": "bigint",
    "estimated_impact": "double",
    "detectors_triggered": "array<string>",
    "assignee": "string",
    "resolution_reason": "string",
    "resolved_at": "timestamp",
    "dedup_key": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}


def new_incidents(run: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the incident table for a run with no earlier incidents."""
    made = {
        "incident_id": F.col("dedup_key"),
        "status": F.lit("open"),
        "created_at": as_of,
        "updated_at": as_of,
    }
    return run.select(
        *[
            made.get(name, F.col(name) if name in run.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in INCIDENT_COLUMNS.items()
        ]
    )


def merge_incidents(existing: DataFrame, run: DataFrame, as_of: Column) -> DataFrame:
    """Next snapshot of the incident table.

    New keys are created; unresolved incidents take the run's score, impact, count and detectors;
    resolved ones and those the run does not mention stay as they are. ``change`` says which.
    """
    rescored = ["severity_score", "estimated_impact", "sku_count", "detectors_triggered", "updated_at"]
    fresh = new_incidents(run, as_of)
    old = existing.alias("old")
    new = fresh.alias("new")
    both = old.join(new, F.col("old.dedup_key") == F.col("new.dedup_key"), "full")
    is_new = F.col("old.dedup_key").isNull()
    hit = F.col("new.dedup_key").isNotNull()
    update = hit & (F.col("old.status") != "resolved")

    def merged(name):
        take_new = (is_new | update) if name in rescored else is_new
        return F.when(take_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    change = F.when(is_new, "created").when(update, "updated").otherwise("unchanged")
    return both.select(*[merged(name) for name in INCIDENT_COLUMNS], change.alias("change"))


def run_counts(run: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Incidents created and updated by a run.

    Every further group of a key created in this run counts as an update, and so does every group
    that meets an unresolved existing incident.
    """
    if existing is None:
        known = run.withColumn("status", F.lit(None).cast("string"))
    else:
        known = run.join(existing.select("dedup_key", "status"), "dedup_key", "left")
    updates = (
        F.when(F.col("status").isNull(), F.col("groups") - 1)
        .when(F.col("status") != "resolved", F.col("groups"))
        .otherwise(0)
    )
    return known.agg(
        F.count_if(F.col("status").isNull()).alias("incidents_created"),
        F.coalesce(F.sum(updates), F.lit(0)).alias("incidents_updated"),
    )


def incident_items(run: DataFrame, flagged: DataFrame, detections: DataFrame) -> DataFrame:
    """SKUs of each incident's creating group, their share of its impact and all their detections."""
    created = run.select(F.col("dedup_key").alias("incident_id"), "date", "store_id", "first_impact")
    items = flagged.join(created, GROUP).select(
        "incident_id",
        *ROW,
        F.when(F.col("first_impact") == 0, 0.0)
        .otherwise(F.try_divide("impact", "first_impact"))
        .alias("contribution_score"),
    )
    return (
        items.join(detections.select(*ROW, "detection_id"), ROW)
        .groupBy("incident_id", "date", "store_id", "sku_id", "contribution_score")
        .agg(F.sort_array(F.collect_list("detection_id")).alias("detection_result_ids"))
    )


def creation_notes(run: DataFrame, as_of: Column) -> DataFrame:
    return run.select(
        F.col("dedup_key").alias("incident_id"),
        F.lit("system").alias("author"),
        F.concat(
            F.lit("Incident created by automated detection. Triggered by: "),
            F.array_join("first_detectors", ", "),
        ).alias("content"),
        F.lit("status_change").alias("note_type"),
        as_of.alias("created_at"),
    )
