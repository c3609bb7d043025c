"""Detection on any table with declared roles: whole-table fences and one forest."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.quantiles import exact_quantiles
from fenceline.functions.text import fixed, short_hash
from fenceline.operators.forest import single_scope_scores
from fenceline.operators.incidents import INCIDENT_COLUMNS
from fenceline.operators.ingest import DatasetSchema
from fenceline.operators.tukey import QUARTILES, with_fences
from fenceline.settings import DEFAULTS, DetectionSettings

# Columns that only one of the two detectors fills.
ONE_DETECTOR_ONLY = {
    "reasons": "array<struct<feature:string,z_score:double,message:string>>",
    "reason": "string",
    "metric_name": "string",
    "metric_order": "int",
}
# List lengths and thresholds of the explanations.
TOP_REASONS = 3
MIN_REASON_Z = 2.0
Z_SMOOTHING = 1e-8
DESCRIBED_FLAGS = 5
DESCRIBED_REASONS = 2


class NoMetrics(ValueError):
    pass


class NoRows(ValueError):
    pass


def check(rows: DataFrame, schema: DatasetSchema) -> None:
    """Typed errors for the inputs that cannot be analysed."""
    if not schema.metrics:
        raise NoMetrics(f"Dataset {schema.dataset_id} declares no metric to look at")
    if rows.isEmpty():
        raise NoRows(f"Dataset {schema.dataset_id} has no data rows")


def long_metrics(rows: DataFrame, schema: DatasetSchema, keep=("row_id", "date", "identifier_key", "label")) -> DataFrame:
    """One row per (row, metric) with a value; NaN counts as missing."""
    nothing = F.lit(None).cast("double")
    cells = [
        F.struct(
            F.lit(i).alias("metric_order"),
            F.lit(name).alias("metric_name"),
            F.nanvl(F.col(name).cast("double"), nothing).alias("actual_value"),
        )
        for i, name in enumerate(schema.metrics)
    ]
    return rows.select(*keep, F.inline(F.array(*cells))).filter("actual_value is not null")


def with_label(rows: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Add the readable identifier text, e.g. ``store=A, sku=7``; the key when all are empty."""
    parts = [
        F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{c}="), F.col(c)))
        for c in schema.identifiers
    ]
    text = F.concat_ws(", ", *parts) if parts else F.lit("")
    return rows.withColumn("label", F.when(text != "", text).otherwise(F.col("identifier_key")))


def flexible_tukey(rows: DataFrame, schema: DatasetSchema, settings: DetectionSettings = DEFAULTS) -> DataFrame:
    """One result per non-null value, against the quartiles of its whole column.

    Columns with fewer than ten values are skipped. The quartiles (one row per declared metric) are
    broadcast back; nothing else is shuffled but the counted values.
    """
    long = long_metrics(with_label(rows, schema), schema)
    quartiles = exact_quantiles(long, "metric_name", "actual_value", QUARTILES, ("q1", "q3"))
    usable = quartiles.filter(F.col("n") >= settings.flexible_min_values)
    fenced = long.join(F.broadcast(usable), "metric_name").withColumn("iqr", F.col("q3") - F.col("q1"))
    told = with_fences(fenced, settings.fence_factor)
    side = F.when(F.col("actual_value") < F.col("lower_fence"), F.lit("below")).otherwise(F.lit("above"))
    reason = F.concat(
        F.col("metric_name"),
        F.lit(" value "),
        fixed(F.col("actual_value"), 2),
        F.lit(" is "),
        side,
        F.lit(" normal range ["),
        fixed(F.col("lower_fence"), 2),
        F.lit(", "),
        fixed(F.col("upper_fence"), 2),
        F.lit("]"),
    )
    return told.withColumn("detector_type", F.lit("tukey")).withColumn("reason", F.when(F.col("is_outlier"), reason)).drop("n")


def complete_rows(rows: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Rows with a value in every metric."""
    nothing = F.lit(None).cast("double")
    typed = rows.withColumns({c: F.nanvl(F.col(c).cast("double"), nothing) for c in schema.metrics})
    return typed.dropna(subset=schema.metrics)


def flexible_zscores(rows: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Absolute z of each metric of each complete row: columns row_id, metric_order, metric_name, z."""
    complete = complete_rows(rows, schema)
    long = long_metrics(complete, schema, keep=("row_id",))
    stats = long.groupBy("metric_name").agg(
        F.avg("actual_value").alias("mean"), F.stddev_pop("actual_value").alias("std")
    )
    scaled = F.abs((F.col("actual_value") - F.col("mean")) / F.col("std"))
    return long.join(F.broadcast(stats), "metric_name").select(  # one row per declared metric
        "row_id",
        "metric_order",
        "metric_name",
        F.when(F.col("std") > 0, scaled / (1 + Z_SMOOTHING)).otherwise(0.0).alias("z"),
    )


def flexible_forest(rows: DataFrame, schema: DatasetSchema, settings: DetectionSettings = DEFAULTS) -> DataFrame | None:
    """Score and flag of each complete row; None with fewer than two metrics or twenty rows.

    One pass over the complete rows yields their count and, per metric, mean and deviation. Those few
    numbers are the only thing the driver sees.
    """
    if len(schema.metrics) < 2:
        return None
    complete = complete_rows(with_label(rows, schema), schema)
    stats = complete.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(schema.metrics)],
        *[F.stddev_pop(c).alias(f"std{i}") for i, c in enumerate(schema.metrics)],
    ).first()
    if stats["rows"] < settings.flexible_forest_min_rows:
        return None
    keyed = complete.select(
        F.col("row_id").cast("string").alias("row_key"),
        "row_id",
        F.unix_date("date").alias("day"),
        "identifier_key",
        "label",
        *schema.metrics,
    )
    zs = []
    for i, c in enumerate(schema.metrics):
        mean, std = stats[f"mean{i}"], stats[f"std{i}"]
        z = F.abs((F.col(c) - mean) / std) / (1 + Z_SMOOTHING) if std else F.lit(0.0)
        zs.append(F.struct(F.lit(c).alias("feature"), z.alias("z")))
    scored = single_scope_scores(keyed, schema.metrics, stats["rows"], settings).withColumn("zs", F.array(*zs))
    order = F.transform(
        F.array_sort(F.transform("zs", lambda e, i: F.struct((-e["z"]).alias("a"), i.alias("i"), e.alias("e")))),
        lambda x: x["e"],
    )
    notable = F.filter(F.slice(order, 1, TOP_REASONS), lambda e: e["z"] > MIN_REASON_Z)
    told = F.transform(
        notable,
        lambda e: F.struct(
            e["feature"].alias("feature"),
            e["z"].alias("z_score"),
            F.concat(e["feature"], F.lit(" is "), fixed(e["z"], 1), F.lit(" standard deviations from mean")).alias("message"),
        ),
    )
    return scored.select(
        "row_id",
        F.date_from_unix_date("day").alias("date"),
        "identifier_key",
        "label",
        F.lit("isolation_forest").alias("detector_type"),
        "anomaly_score",
        F.col("is_anomaly").alias("is_outlier"),
        F.when(F.col("is_anomaly"), told).otherwise(F.slice(told, 1, 0)).alias("reasons"),
    )


def flexible_detections(tukey: DataFrame, forest: DataFrame | None) -> DataFrame:
    """Both detectors in one table, whole."""
    return tukey if forest is None else tukey.unionByName(forest, allowMissingColumns=True)


def flexible_incidents(
    detections: DataFrame, schema: DatasetSchema, run_date: dt.date
) -> DataFrame:
    """One incident per identifier with flags, in the shape ``merge_incidents`` takes.

    Counts use partial aggregation; the first five flags are cut per map task before the shuffle,
    so an identifier that holds most flags is never gathered. Rows without identifier make none.
    """
    flags = detections.filter("is_outlier and identifier_key is not null")
    for name, kind in ONE_DETECTOR_ONLY.items():
        if name not in flags.columns:
            flags = flags.withColumn(name, F.lit(None).cast(kind))
    tukey, forest = F.col("detector_type") == "tukey", F.col("detector_type") == "isolation_forest"
    totals = flags.groupBy("identifier_key").agg(
        F.min("date").alias("date"),
        F.count(F.lit(1)).alias("flags"),
        F.bool_or(tukey).alias("by_tukey"),
        F.bool_or(forest).alias("by_forest"),
        F.array_sort(F.collect_set("metric_name")).alias("metrics"),
        F.min("label").alias("label"),
    )
    order = Window.partitionBy("identifier_key").orderBy(
        F.desc(tukey), F.asc_nulls_last("metric_order"), F.asc_nulls_last("date"), "row_id"
    )
    told = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(
        F.transform(F.slice("reasons", 1, DESCRIBED_REASONS), lambda r: r["message"])
    )
    first = (
        flags.select("identifier_key", "detector_type", "metric_order", "date", "row_id", told.alias("told"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= DESCRIBED_FLAGS)
        .groupBy("identifier_key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "told"))).alias("first"))
    )
    lines = F.transform(
        F.flatten(F.transform("first", lambda f: F.coalesce(f["told"], F.array().cast("array<string>")))),
        lambda t: F.concat(F.lit("• "), t),
    )
    detectors = F.filter(
        F.array(F.when(F.col("by_tukey"), F.lit("tukey")), F.when(F.col("by_forest"), F.lit("isolation_forest"))),
        lambda d: d.isNotNull(),
    )
    day = F.coalesce("date", F.lit(run_date))
    about = F.when(
        F.size("metrics") > 0, F.concat(F.lit("Anomalies in "), F.array_join("metrics", ", "))
    ).otherwise(F.lit("Anomalies detected"))
    key = short_hash(
        F.concat_ws("_", F.lit(str(schema.dataset_id)), "identifier_key", F.date_format(day, "yyyy-MM-dd"))
    )
    made = {
        "dedup_key": key,
        "date": day,
        "store_id": F.col("label"),
        "dataset_id": F.lit(schema.dataset_id),
        "headline": F.concat(about, F.lit(" for "), "label"),
        "description": F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("Multiple anomalies detected"),
        "severity_score": F.least(20 + F.col("flags") * 5 + F.size(detectors) * 15, F.lit(100)),
        "sku_count": F.lit(1),
        "estimated_impact": F.lit(0.0),
        "detectors_triggered": detectors,
    }
    shaped = totals.join(first, "identifier_key").select(
        *[column.cast(INCIDENT_COLUMNS[name]).alias(name) for name, column in made.items()]
    )
    return shaped.withColumn("groups", F.lit(1).cast("bigint"))


def creation_notes(incidents: DataFrame, schema: DatasetSchema, as_of) -> DataFrame:
    text = f"Incident created from flexible dataset '{schema.name}'. Analyzed metrics: {', '.join(schema.metrics)}"
    return incidents.select(
        F.col("dedup_key").alias("incident_id"),
        F.lit("system").alias("author"),
        F.lit(text).alias("content"),
        F.lit("status_change").alias("note_type"),
        as_of.alias("created_at"),
    )
