"""Clean rows by declared column roles, report bad ones, and pack good ones."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.parsing import clean_identifier, parse_typed_date, parse_typed_number
from fenceline.functions.text import short_hash
from fenceline.sources.shared import materialize

# The two row errors; a CSV data row is numbered from line 2.
NO_IDENTIFIER = "All identifier columns are empty"
NO_METRIC = "All metric columns are empty"
FIRST_DATA_LINE = 2


@dataclass(frozen=True)
class DatasetSchema:
    """Roles of the columns of one dataset."""

    dataset_id: int
    name: str = ""
    date_column: str | None = None
    identifiers: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        dated = [self.date_column] if self.date_column else []
        return [*dated, *self.identifiers, *self.metrics, *self.attributes]


class MissingColumns(ValueError):
    def __init__(self, missing, available):
        super().__init__(f"CSV is missing required columns {missing}; available are {available}")
        self.missing, self.available = missing, available


def require_columns(df: DataFrame, schema: DatasetSchema) -> None:
    """Raise before any job runs when a declared column is not there."""
    missing = [c for c in schema.columns if c not in df.columns]
    if missing:
        raise MissingColumns(missing, list(df.columns))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, 2, ... in read order without moving them.

    The rows are stored once with their partition and place in it, so the source is read once and partitions
    need not come out the same twice; running offsets, one per partition, are joined to the stored rows.
    """
    # The id's upper part is the partition, its lower 33 bits the position inside.
    placed = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    )
    position = F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "__part").select(
        (F.col("__start") + position).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def identifier_key(schema: DatasetSchema) -> Column:
    """Hash of the sorted ``name=value`` pairs that are present; NULL when none is."""
    if not schema.identifiers:
        return F.lit(None).cast("string")
    ordered = sorted(schema.identifiers)
    pairs = [F.concat(F.lit(f"{name}="), F.col(name)) for name in ordered]
    return F.when(F.coalesce(*[F.col(c) for c in ordered]).isNotNull(), short_hash(F.concat_ws("|", *pairs)))


def clean(df: DataFrame, schema: DatasetSchema, row_index: str = "row_index") -> DataFrame:
    """Parse every declared column by its role and list each row's errors.

    A bad date leaves the date NULL without making the row invalid.
    """
    require_columns(df, schema)
    kinds = dict(df.dtypes)
    date = (
        parse_typed_date(F.col(schema.date_column), kinds[schema.date_column])
        if schema.date_column
        else F.lit(None).cast("date")
    )
    typed = df.select(
        F.col(row_index),
        date.alias("date"),
        *[clean_identifier(F.col(c)).alias(c) for c in schema.identifiers],
        *[parse_typed_number(F.col(c), kinds[c]).alias(c) for c in schema.metrics],
        *schema.attributes,
    )

    def empty(columns):
        return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull() if columns else F.lit(False)

    no_id, no_metric = empty(schema.identifiers), empty(schema.metrics)
    errors = (
        F.when(no_id & no_metric, F.array(F.lit(NO_IDENTIFIER), F.lit(NO_METRIC)))
        .when(no_id, F.array(F.lit(NO_IDENTIFIER)))
        .when(no_metric, F.array(F.lit(NO_METRIC)))
        .otherwise(F.array().cast("array<string>"))
    )
    return typed.select(
        "*",
        (~no_id & ~no_metric).alias("is_valid"),
        errors.alias("errors"),
        identifier_key(schema).alias("identifier_key"),
    )


def valid_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("is_valid").drop("is_valid", "errors")


def row_errors(cleaned: DataFrame, row_index: str = "row_index") -> DataFrame:
    """Every error with its line; a row can have two."""
    return cleaned.filter("not is_valid").select(
        (F.col(row_index) + FIRST_DATA_LINE).alias("row"), F.explode("errors").alias("error")
    )


def transform_summary(cleaned: DataFrame) -> DataFrame:
    valid = F.col("is_valid")
    return cleaned.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.count_if(~valid).alias("error_rows"),
    )


def packed_rows(valid: DataFrame, schema: DatasetSchema, row_index: str = "row_index") -> DataFrame:
    """Rows with identifiers, metrics and attributes as maps without NULLs."""

    def packed(columns, kind):
        if not columns:
            return F.create_map().cast(f"map<string,{kind}>")
        values = F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast(kind) for c in columns])
        )
        return F.map_filter(values, lambda k, v: v.isNotNull())

    return valid.select(
        F.lit(schema.dataset_id).cast("bigint").alias("dataset_id"),
        F.col(row_index).cast("bigint").alias("row_id"),
        "date",
        packed(schema.identifiers, "string").alias("identifiers"),
        packed(schema.metrics, "double").alias("metrics"),
        packed(schema.attributes, "string").alias("attributes"),
        "identifier_key",
    )


def dataset_page(
    rows: DataFrame, limit: int = 100, offset: int = 0, identifier=None, date_from=None, date_to=None
) -> DataFrame:
    """Packed rows, newest first (undated ones before), with optional filters."""
    return (
        filter_rows(rows, identifier, date_from, date_to)
        .orderBy(F.desc_nulls_first("date"), "row_id")
        .offset(offset)
        .limit(limit)
    )


def dataset_cursor(page: DataFrame) -> tuple | None:
    """Place of the last row of a page in the order of pages; None for an empty page."""
    last = page.orderBy(F.asc_nulls_last("date"), F.desc("row_id")).select("date", "row_id").first()
    return tuple(last) if last else None


def dataset_page_after(
    rows: DataFrame, cursor: tuple | None, limit: int = 100, identifier=None, date_from=None, date_to=None
) -> DataFrame:
    """The rows behind a place, however deep; ``None`` is the place before all."""
    rows = filter_rows(rows, identifier, date_from, date_to)
    if cursor:
        date, row_id = cursor
        if date is None:
            rows = rows.filter(F.col("date").isNotNull() | (F.col("row_id") > row_id))
        else:
            same_day = (F.col("date") == F.lit(date)) & (F.col("row_id") > row_id)
            rows = rows.filter(F.col("date") <= F.lit(date)).filter((F.col("date") < F.lit(date)) | same_day)
    return rows.orderBy(F.desc_nulls_first("date"), "row_id").limit(limit)


def filter_rows(rows: DataFrame, identifier=None, date_from=None, date_to=None) -> DataFrame:
    if identifier:
        rows = rows.filter(F.col("identifier_key") == identifier)
    if date_from:
        rows = rows.filter(F.col("date") >= F.lit(date_from))
    if date_to:
        rows = rows.filter(F.col("date") <= F.lit(date_to))
    return rows


def unique_identifiers(rows: DataFrame) -> DataFrame:
    """Each identifier key with its values and number of rows."""
    return rows.groupBy("identifier_key").agg(
        F.any_value("identifiers").alias("identifiers"), F.count(F.lit(1)).alias("rows")
    )


def preview_rows(df: DataFrame, order_by: str, n: int = 20) -> DataFrame:
    return df.orderBy(order_by).limit(n)
