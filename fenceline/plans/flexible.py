"""Flexible pipeline: any table with declared roles, from CSV upload to incidents."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.functions.summary import side_by_side
from fenceline.operators import flexible as flex
from fenceline.operators import incidents as inc
from fenceline.operators import ingest
from fenceline.operators.ingest import DatasetSchema
from fenceline.operators.profile import profile, suggest_schema
from fenceline.settings import DEFAULTS, DetectionSettings
from fenceline.sources import datasets
from fenceline.sources.csv import read_csv, with_types
from fenceline.sources.shared import materialize


@dataclass(frozen=True)
class FlexibleRun:
    detections: DataFrame
    incidents: DataFrame
    notes: DataFrame
    stats: DataFrame


def run_flexible_detection(
    rows: DataFrame,
    schema: DatasetSchema,
    as_of: dt.datetime,
    existing: DataFrame | None = None,
    settings: DetectionSettings = DEFAULTS,
) -> FlexibleRun:
    """``rows``: row_id, date, identifier_key, identifiers and metrics as typed columns."""
    flex.check(rows, schema)
    tukey = flex.flexible_tukey(rows, schema, settings)
    detections = materialize(
        flex.flexible_detections(tukey, flex.flexible_forest(rows, schema, settings)), "flexible-detections"
    )
    run = materialize(flex.flexible_incidents(detections, schema, as_of.date()), "flexible-run")
    now = F.lit(as_of)
    if existing is None:
        created, incidents = run, inc.new_incidents(run, now)
    else:
        created = run.join(existing.select("dedup_key"), "dedup_key", "left_anti")
        incidents = inc.merge_incidents(existing, run, now).drop("change")
    stats = side_by_side(
        rows.agg(F.count(F.lit(1)).alias("rows_analyzed")),
        detections.agg(F.count_if("is_outlier").alias("total_flags")),
        inc.run_counts(run, existing),
    )
    return FlexibleRun(detections, incidents, flex.creation_notes(created, schema, now), stats)


@dataclass(frozen=True)
class Analysis:
    profile: DataFrame
    suggestion: DataFrame
    preview: DataFrame


def analyze_csv(spark: SparkSession, path: str) -> Analysis:
    """Profile, suggested roles and the first rows of a CSV file."""
    df = ingest.with_row_index(read_csv(spark, path))
    columns = profile(df, order_by="row_index")
    return Analysis(columns, suggest_schema(columns), ingest.preview_rows(df, "row_index").drop("row_index"))


@dataclass(frozen=True)
class Upload:
    registry: DataFrame
    rows: DataFrame
    summary: DataFrame
    errors: DataFrame


class NoValidRows(ValueError):
    pass


def upload(spark: SparkSession, registry: DataFrame, dataset_id: int, csv_path: str, rows_path: str) -> Upload:
    """Read a CSV by the dataset's roles, append its valid rows, and update the registry entry."""
    schema = datasets.get_schema(registry, dataset_id)
    source = read_csv(spark, csv_path, infer_types=False)
    ingest.require_columns(source, schema)
    # Stored with its row numbers; nothing reads the CSV again.
    source = ingest.with_row_index(source)
    cleaned = materialize(ingest.clean(source, schema), "cleaned")
    summary, errors = ingest.transform_summary(cleaned), ingest.row_errors(cleaned)
    packed = ingest.packed_rows(ingest.valid_rows(cleaned), schema)
    # Row ids go on behind those of earlier uploads.
    packed = packed.withColumn("row_id", F.col("row_id") + datasets.next_row_id(spark, rows_path, dataset_id))
    if packed.isEmpty():
        raise NoValidRows(f"No valid rows after transformation: {errors.orderBy("row", "error").take(20)}")
    datasets.append_rows(packed, rows_path)
    registry = datasets.add_stats(registry, packed)
    registry = datasets.store_analysis(registry, dataset_id, profile(with_types(source), order_by="row_index"))
    return Upload(registry, packed, summary, errors)


def upload_with_schema(spark, registry, dataset_id, schema_json: str, csv_path, rows_path, as_of) -> Upload:
    """Change the dataset's roles and upload in one step."""
    datasets.get_schema(registry, dataset_id)
    changed = datasets.update_schema(registry, dataset_id, as_of, schema_json)
    return upload(spark, changed, dataset_id, csv_path, rows_path)


def unpack_rows(packed: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Stored rows of one dataset as typed columns, the input of ``run_flexible_detection``."""
    mine = packed.filter(F.col("dataset_id") == schema.dataset_id)
    return mine.select(
        "row_id",
        "date",
        "identifier_key",
        *[F.col("identifiers")[c].alias(c) for c in schema.identifiers],
        *[F.col("metrics")[c].alias(c) for c in schema.metrics],
    )
