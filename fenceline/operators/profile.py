"""Column profiles, detected types and suggested roles of a table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.parsing import date_from_text, to_number
from fenceline.sources.shared import materialize

# Words that hint at a column's role (matched as substrings of the lower-case name),
# accepted boolean texts, texts that count as blank, and the number of sample values.
DATE_WORDS = ["date", "time", "day", "month", "year", "created", "updated", "timestamp", "dt"]
ID_WORDS = [
    "id", "code", "key", "name", "store", "product", "sku", "item",
    "customer", "user", "location", "branch", "region", "category",
    "department", "supplier", "vendor",
]
METRIC_WORDS = [
    "amount", "total", "count", "qty", "quantity", "price", "cost",
    "value", "sales", "revenue", "profit", "stock", "inventory",
    "sold", "returned", "delivered", "units", "volume", "weight",
    "score", "rating", "percent", "rate", "avg", "sum", "balance",
]
BOOLEAN_TEXTS = ["true", "false", "yes", "no", "y", "n", "1", "0", "t", "f", "on", "off"]
BLANK_TEXTS = ["", "nan", "null", "none", "na"]
SAMPLE_VALUES = 5
STATISTICS = ["min_value", "max_value", "mean_value", "std_value"]

WARNINGS = (
    ("date_column", "No date column detected. Time-series analysis will be limited."),
    ("identifiers", "No identifier columns detected. Data will be analyzed at row level."),
    ("metrics", "No metric columns detected. Please select columns to analyze."),
)


def _storage(dtype: str) -> str:
    """Type that the storage type alone decides; empty for text, whose values decide."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    if dtype == "boolean":
        return "boolean"
    if dtype == "date" or dtype.startswith("timestamp"):
        return "datetime"
    return ""


def _has_word(words) -> Column:
    name = F.lower("column_name")
    hit = F.lit(False)
    for word in words:
        hit = hit | name.contains(word)
    return hit


def cells(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """One row per cell: column ordinal, name, storage type, text value, and the row's order.

    Without ``order_by`` the order is the read order of the files.
    """
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    names = [c for c in df.columns if c != order_by]
    kinds = dict(df.dtypes)

    def cell(i, name):
        value = F.col(f"`{name}`").cast("string")
        if _storage(kinds[name]) == "float":
            value = F.when(~F.isnan(F.col(f"`{name}`").cast("double")), value)
        return F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column_name"),
            F.lit(_storage(kinds[name])).alias("storage"),
            value.alias("value"),
        )

    return df.withColumn("__order", order).select(
        "__order", F.inline(F.array(*[cell(i, n) for i, n in enumerate(names)]))
    )


COLUMN_KEY = ["ordinal", "column_name", "storage"]


def value_counts(long: DataFrame) -> DataFrame:
    """Rows and first appearance of each distinct value of each column.

    Equal values are combined in the map tasks, so frequent ones cost nothing in the shuffle.
    """
    return long.groupBy(*COLUMN_KEY, "value").agg(
        F.count(F.lit(1)).alias("rows"), F.min("__order").alias("first_seen")
    )


def column_counts(long: DataFrame, approximate: bool = False) -> DataFrame:
    """``summary`` of the cells' distinct values, which cross the shuffle once.

    ``approximate`` replaces the exact distinct count by a sketch of fixed size; then only one small row per
    column and task is shuffled.
    """
    if approximate:
        return summary(long.withColumn("rows", F.lit(1)), F.approx_count_distinct("value"))
    return summary(value_counts(long))


def sample_values(values: DataFrame) -> DataFrame:
    """The first five distinct values of each column, in order of appearance, from its ``value_counts``.

    The limit is applied in the map tasks.
    """
    rank = F.row_number().over(Window.partitionBy(*COLUMN_KEY).orderBy("first_seen", "value"))
    return (
        values.filter("value is not null")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= SAMPLE_VALUES)
        .groupBy(*COLUMN_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select(*COLUMN_KEY, F.transform("s", lambda x: x["value"]).alias("sample_values"))
    )


EVIDENCE = ["named_dates", "unnamed_dates", "words", "integers", "numbers", "number_rows"]


def summary(values: DataFrame, unique: Column | None = None) -> DataFrame:
    """Total, nulls, distinct values and their share per column, and what the values of a text column look like.

    ``values`` holds each value with its number of rows, so each distinct value is parsed once. Partial
    aggregation over numbers only; ``words`` is how many different boolean texts there are, if all values are such.
    """
    present = F.col("value").isNotNull()
    text = F.when(present & (F.col("storage") == ""), F.col("value"))
    bare = F.translate(F.trim("text"), ", ", "")
    read = (
        values.withColumn("text", text)
        .withColumns({"bare": bare, "word": F.lower(F.trim("text")), "day": date_from_text(F.col("text"))})
        .withColumn("plain", F.translate("bare", "£$€", ""))
        .withColumns({"whole": to_number(F.col("bare")), "money": to_number(F.col("plain"))})
    )
    whole, money, word, rows = F.col("whole"), F.col("money"), F.col("word"), F.col("rows")
    blank, money_blank = F.col("bare").isin(*BLANK_TEXTS), F.col("plain").isin(*BLANK_TEXTS)

    # One bit per boolean text: a number as the state of the aggregation, which a set of words would keep out of hash tables of numbers.
    place = F.array_position(F.array(*[F.lit(w) for w in BOOLEAN_TEXTS]), word).cast("int")
    word_bit = F.when(word.isin(*BOOLEAN_TEXTS), F.call_function("shiftleft", F.lit(1), place))

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, rows)), F.lit(0))

    counts = read.groupBy(*COLUMN_KEY).agg(
        F.sum("rows").alias("total_count"),
        rows_where(~present).alias("null_count"),
        (F.count("value") if unique is None else unique).alias("unique_count"),
        rows_where(F.col("day").isNotNull()).alias("named_dates"),
        rows_where(F.year("day").between(1900, 2100)).alias("unnamed_dates"),
        F.when(F.bool_and(word.isin(*BOOLEAN_TEXTS)), F.bit_count(F.bit_or(word_bit))).alias("words"),
        F.bool_and(F.when(present, blank | F.coalesce(whole == F.floor(whole), F.lit(False)))).alias("integers"),
        F.bool_and(F.when(present, money_blank | money.isNotNull())).alias("numbers"),
        rows_where(~money_blank & money.isNotNull()).alias("number_rows"),
    )
    total, ratio = F.col("total_count"), F.try_divide("unique_count", "total_count")
    counts = counts.withColumn("cardinality_ratio", F.when(total > 0, ratio).otherwise(0.0))
    return counts.select(*[c for c in counts.columns if c not in EVIDENCE], *EVIDENCE)


def detect_types(counts: DataFrame) -> DataFrame:
    """``detected_type`` in place of the evidence: the storage type, or for text the first test that passes."""
    named = _has_word(DATE_WORDS)
    filled = F.col("total_count") - F.col("null_count")
    looks_dated = F.when(named, F.col("named_dates")).otherwise(F.col("unnamed_dates")) * 2 >= filled
    kind = (
        F.when(filled == 0, "unknown")
        .when(F.col("storage") != "", F.col("storage"))
        .when(looks_dated, "date")
        .when(F.col("words").between(1, 2), "boolean")
        .when(F.col("integers"), "integer")
        .when(F.col("numbers") & (F.col("number_rows") >= filled * 0.8), "float")
        .when(F.col("unique_count") / filled < 0.5, "categorical")
        .otherwise("text")
    )
    return counts.withColumn("detected_type", kind).drop(*EVIDENCE)


def numeric_stats(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of the values that are plain finite numbers, by ordinal.

    One aggregation over the columns as they are stored; no cell is turned into a row.
    """
    nothing, kinds = F.lit(None).cast("double"), dict(df.dtypes)

    def stats(i: int, name: str) -> Column:
        column, kind = F.col(f"`{name}`"), _storage(kinds[name])
        if kind in ("integer", "float") and kinds[name] != "float":
            number = column.cast("double")
            number = F.when(F.abs(number) < float("inf"), number) if kinds[name] == "double" else number
        elif kind in ("boolean", "datetime"):
            number = None
        else:
            # A four-byte float is the number it is shown as.
            number = to_number(F.trim(column.cast("string")))
        values = (nothing,) * 4
        if number is not None:
            deviation = F.when(F.count(number) > 0, F.coalesce(F.stddev_samp(number), F.lit(0.0)))
            values = (F.min(number), F.max(number), F.avg(number), deviation)
        return F.struct(F.lit(i).alias("ordinal"), *[v.alias(c) for v, c in zip(values, STATISTICS)]).alias(f"c{i}")

    names = [c for c in df.columns if c != order_by]
    return df.agg(*[stats(i, n) for i, n in enumerate(names)]).select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))


def suggest_roles(types: DataFrame) -> DataFrame:
    """Add ``suggested_role`` and ``role_confidence``; the first rule that applies wins."""
    kind, ratio, unique = F.col("detected_type"), F.col("cardinality_ratio"), F.col("unique_count")
    text = kind.isin("categorical", "text")
    numeric = kind.isin("integer", "float")
    # Thresholds and confidences of the rules.
    rules = [
        (kind.isin("date", "datetime"), "date", 0.95),
        (_has_word(ID_WORDS) & kind.isin("categorical", "text", "integer"), "identifier", 0.8),
        (_has_word(METRIC_WORDS) & numeric, "metric", 0.9),
        (text & (ratio < 0.1) & (unique < 1000), "identifier", 0.7),
        (text & (ratio < 0.3), "identifier", 0.5),
        (numeric & (ratio > 0.1), "metric", 0.7),
        (numeric & (unique < 50), "identifier", 0.5),
        (numeric, "metric", 0.6),
        (kind == "boolean", "attribute", 0.7),
    ]
    role, confidence = F.lit("attribute"), F.lit(0.3)
    for condition, name, sure in reversed(rules):
        role = F.when(condition, F.lit(name)).otherwise(role)
        confidence = F.when(condition, F.lit(sure)).otherwise(confidence)
    return types.withColumn("suggested_role", role).withColumn("role_confidence", confidence)


def profile(df: DataFrame, order_by: str | None = None, approximate: bool = False) -> DataFrame:
    """One row per column with counts, samples, type, numeric statistics and suggested role.

    Distinct values are counted once and stored for the counts, the types and the samples.
    """
    long = cells(df, order_by)
    values = materialize(value_counts(long), "values")
    roles = suggest_roles(detect_types(column_counts(long, True) if approximate else summary(values)))
    numeric = F.col("detected_type").isin("integer", "float")
    return (
        roles.join(sample_values(values).select("ordinal", "sample_values"), "ordinal", "left")
        .join(numeric_stats(df, order_by), "ordinal", "left")
        .select(
            *roles.columns,
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            *[F.when(numeric, F.col(c)).alias(c) for c in STATISTICS],
        )
        .drop("storage")
    )


def suggest_schema(roles: DataFrame) -> DataFrame:
    """One row: the first date column, identifiers and metrics by confidence, and warnings."""

    def names(role):
        entry = F.struct((-F.col("role_confidence")).alias("c"), "ordinal", "column_name")
        ordered = F.array_sort(F.collect_list(F.when(F.col("suggested_role") == role, entry)))
        return F.transform(ordered, lambda e: e["column_name"])

    first_date = F.min_by("column_name", F.when(F.col("suggested_role") == "date", F.col("ordinal")))
    found = roles.agg(
        first_date.alias("date_column"),
        names("identifier").alias("identifiers"),
        names("metric").alias("metrics"),
    )
    missing = {
        "date_column": F.col("date_column").isNull(),
        "identifiers": F.size("identifiers") == 0,
        "metrics": F.size("metrics") == 0,
    }
    warnings = F.filter(
        F.array(*[F.when(missing[field], F.lit(text)) for field, text in WARNINGS]), lambda w: w.isNotNull()
    )
    return found.withColumn("warnings", warnings)
