"""The dataset registry and the stored rows: small snapshots in, new snapshots out."""

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.operators.ingest import DatasetSchema

REGISTRY = (
    "dataset_id bigint, name string, description string, date_column string, "
    "identifier_columns array<string>, metric_columns array<string>, attribute_columns array<string>, "
    "column_analysis string, row_count bigint, date_range_start date, date_range_end date, "
    "created_at timestamp, updated_at timestamp"
)
SCHEMA_FIELDS = {
    "name": "string",
    "description": "string",
    "date_column": "string",
    "identifier_columns": "array<string>",
    "metric_columns": "array<string>",
    "attribute_columns": "array<string>",
}


class UnknownDataset(ValueError):
    pass


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def create_dataset(registry: DataFrame, dataset_id: int, as_of: dt.datetime, **fields) -> DataFrame:
    """Registry with one more dataset; list fields default to empty."""
    row = {name: fields.get(name, [] if kind.startswith("array") else None) for name, kind in SCHEMA_FIELDS.items()}
    row |= {"dataset_id": dataset_id, "row_count": 0, "created_at": as_of, "updated_at": as_of}
    return registry.unionByName(registry.sparkSession.createDataFrame([row], REGISTRY))


def list_datasets(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.desc("created_at"), "dataset_id")


def get_schema(registry: DataFrame, dataset_id: int) -> DatasetSchema:
    """Roles of one dataset; its registry row is a single bounded record."""
    row = registry.filter(F.col("dataset_id") == dataset_id).first()
    if row is None:
        raise UnknownDataset(f"Dataset {dataset_id} not found")
    return DatasetSchema(
        dataset_id,
        row["name"],
        row["date_column"],
        list(row["identifier_columns"] or []),
        list(row["metric_columns"] or []),
        list(row["attribute_columns"] or []),
    )


def update_schema(registry: DataFrame, dataset_id: int, as_of: dt.datetime, schema_json: str) -> DataFrame:
    """Replace the fields named in a JSON object; others stay."""
    fields = json.loads(schema_json)
    this = F.col("dataset_id") == dataset_id

    def literal(name, value) -> Column:
        made = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        return made.cast(SCHEMA_FIELDS[name])

    new = {name: literal(name, fields[name]) for name in SCHEMA_FIELDS if name in fields}
    new["updated_at"] = F.lit(as_of)
    return registry.withColumns({name: F.when(this, value).otherwise(F.col(name)) for name, value in new.items()})


def delete_dataset(dataset_id: int, *tables: DataFrame) -> list[DataFrame]:
    """The given tables (registry, rows, incidents) without the dataset's records.

    Stored rows are partitioned by dataset, so the filter drops whole partitions.
    """
    keep = ~F.col("dataset_id").eqNullSafe(F.lit(dataset_id))
    return [t.filter(keep) for t in tables]


def delete_children(children: DataFrame, parents: DataFrame, key: str = "incident_id") -> DataFrame:
    """Items or notes whose incident is among ``parents`` (the deleted ones) are removed."""
    return children.join(parents.select(key), key, "left_anti")


def next_row_id(spark: SparkSession, path: str, dataset_id: int) -> int:
    """The first row id that no stored row of the dataset has; 0 where nothing is stored yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    highest = stored.filter(F.col("dataset_id") == dataset_id).agg(F.max("row_id")).first()[0]
    return 0 if highest is None else highest + 1


def append_rows(packed: DataFrame, path: str) -> None:
    packed.write.mode("append").partitionBy("dataset_id").parquet(path)


def add_stats(registry: DataFrame, packed: DataFrame) -> DataFrame:
    """Row counts grow by the new rows; date ranges widen."""
    added = packed.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("date").alias("__from"), F.max("date").alias("__to")
    )
    joined = registry.join(added, "dataset_id", "left")
    return joined.withColumns(
        {
            "row_count": F.col("row_count") + F.coalesce("__rows", F.lit(0)),
            "date_range_start": F.least("date_range_start", "__from"),
            "date_range_end": F.greatest("date_range_end", "__to"),
        }
    ).select(*registry.columns)


def store_analysis(registry: DataFrame, dataset_id: int, profile: DataFrame) -> DataFrame:
    """Keep the column profile (one entry per column) with its dataset, as JSON."""
    entry = F.struct("ordinal", F.struct(
        F.col("column_name").alias("name"), "detected_type", "suggested_role", "unique_count", "null_count"
    ).alias("column"))
    analysis = profile.agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["column"])).alias("__analysis")
    ).withColumn("dataset_id", F.lit(dataset_id).cast("bigint"))
    return (
        registry.join(F.broadcast(analysis), "dataset_id", "left")
        .withColumn("column_analysis", F.coalesce("__analysis", "column_analysis"))
        .select(*registry.columns)
    )


def overwrite_dates(df: DataFrame, path: str) -> None:
    """Replace exactly the dates present in ``df``, so a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
