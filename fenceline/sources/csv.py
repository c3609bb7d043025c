"""CSV files with a header, in UTF-8 or else Latin-1."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenceline.sources.shared import materialize

# Whole cells that stand for a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The syntax of whole and other numbers and of truth values in a cell.
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TRUTH = ["True", "False", "TRUE", "FALSE", "true", "false"]


def _facts(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether some line has an odd number of quotes, so that a cell goes over lines."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    bad, broken = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8(line)), F.bool_or(quotes % 2 == 1)).first()
    return ("ISO-8859-1" if bad else "UTF-8"), bool(broken)


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8; then every byte is taken as Latin-1."""
    return _facts(spark, path)[0]


def with_types(df: DataFrame) -> DataFrame:
    """Text columns whose present cells are all whole numbers, numbers or truth values, as such.

    All rows decide, in one aggregation; a column without values stays text.
    """

    def all_cells(test: Column) -> Column:
        return F.coalesce(F.bool_and(test), F.lit(False))

    tests = []
    for i, (name, kind) in enumerate(df.dtypes):
        if kind == "string":
            c = F.col(f"`{name}`")
            tests += [all_cells(c.rlike(WHOLE)).alias(f"i{i}"), all_cells(c.rlike(NUMBER)).alias(f"f{i}")]
            tests.append(all_cells(c.isin(*TRUTH)).alias(f"b{i}"))
    if not tests:
        return df
    found = df.agg(*tests).first().asDict()

    def typed(i, name):
        c = F.col(f"`{name}`")
        for key, kind in (("i", "bigint"), ("f", "double"), ("b", "boolean")):
            if found.get(f"{key}{i}"):
                return F.trim(c).cast(kind).alias(name)
        return c

    return df.select(*[typed(i, name) for i, name in enumerate(df.columns)])


def _effect(lines: DataFrame) -> DataFrame:
    """What a line does to the state "inside a quoted cell" (0 or 1): ``state`` behind it where that is certain,
    else NULL, and otherwise by ``changes`` how often it changes the state.

    Doubled quotes stand for one inside a cell and for an empty cell outside; neither changes the state. Of the
    others, one at the beginning of a cell opens it or, inside, closes it: a change. Any other closes or is
    plain text, so outside is certain behind it. Each step is a column of its own, so that it runs once a line.
    """
    opener, quoted = "\x01", F.col("line").contains('"')
    single = F.replace(F.translate("line", opener, ""), F.lit('""'), F.lit(""))
    marked = lines.withColumn("marked", F.when(quoted, F.regexp_replace(single, '(^|,)"', f"$1{opener}")))
    tail = marked.withColumn("tail", F.substring_index("marked", '"', -1))
    certain = F.col("marked").contains('"')
    changes = F.length("tail") - F.length(F.translate("tail", opener, ""))
    counted = tail.withColumns({"certain": certain, "changes": F.coalesce(changes, F.lit(0))})
    return counted.withColumns(
        {"state": F.when(F.col("certain"), F.col("changes") % 2), "changes": F.when(F.col("certain"), 0).otherwise(F.col("changes"))}
    ).drop("marked", "tail", "certain")


def _run(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Along an order, add ``certain``: the state behind each row where some row so far makes it certain, and
    ``parity``: whether the state at the beginning is changed by then, where none does."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("parity", F.sum("changes").over(w) % 2)
    anchor = F.last((F.col("state") + F.col("parity")) % 2, ignorenulls=True).over(w)
    return df.withColumn("certain", (anchor + F.col("parity")) % 2)


def records(lines: DataFrame) -> DataFrame:
    """Lines (file, block, id, line) joined to records (file, block, id, text, leads); the first record of a
    file leads.

    ``block`` is the place of a split in its file and ``id`` orders the lines of a split. A first pass reduces each
    split to what it does to the state and where its last record begins, for either state at its own beginning:
    one row. Running over the splits of a file that gives the state in which each begins. A cell that is never
    closed takes in the rest of its file.
    """
    split = ["file", "block"]
    w = Window.partitionBy(*split).orderBy("id")
    marked = _run(_effect(lines), split, "id")

    def before(begin: Column) -> Column:
        return F.coalesce(F.lag(F.coalesce("certain", (F.col("parity") + begin) % 2)).over(w), begin)

    either = marked.withColumns({"open0": before(F.lit(0)), "open1": before(F.lit(1))})
    splits = either.groupBy(*split).agg(
        F.max_by(F.struct("certain", "parity"), "id").alias("last"),
        F.max(F.when(F.col("open0") == 0, F.col("id"))).alias("start0"),
        F.max(F.when(F.col("open1") == 0, F.col("id"))).alias("start1"),
    )
    splits = splits.select(
        *split, "start0", "start1", F.col("last.certain").alias("state"),
        F.when(F.col("last.certain").isNull(), F.col("last.parity")).otherwise(0).alias("changes"),
    )
    along = Window.partitionBy("file").orderBy("block")
    splits = _run(splits, ["file"], "block").withColumn(
        "begin", F.coalesce(F.lag(F.coalesce("certain", "parity")).over(along), F.lit(0))
    )
    start = F.when(F.col("begin") == 0, F.col("start0")).otherwise(F.col("start1"))
    place = F.when(start.isNotNull(), F.struct(F.col("block").alias("block"), start.alias("id")))
    carried = F.last(place, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("carried", carried).select(*split, "begin", "carried")

    opened = marked.join(splits, split).withColumn("open", before(F.col("begin")))
    own = F.last(F.when(F.col("open") == 0, F.struct(F.col("block").alias("block"), F.col("id").alias("id"))), ignorenulls=True)
    own = own.over(w.rowsBetween(Window.unboundedPreceding, 0))
    leads = (F.col("block") == 0) & (F.row_number().over(w) == 1)
    placed = opened.select(
        "file", F.coalesce(own, "carried").alias("at"), F.struct("block", "id", "line").alias("part"), leads.alias("leads")
    )
    placed = placed.select("file", "at.block", "at.id", "part", "leads")
    text = F.array_join(F.sort_array(F.collect_list("part"))["line"], "\n")
    return placed.groupBy("file", "block", "id").agg(text.alias("text"), F.bool_or("leads").alias("leads"))


def _quoted_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """CSV whose quoted cells may go over lines, by as many tasks as the files have splits; rows in order."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.decode(F.col("value").cast("binary"), encoding).alias("line"),
    )
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    # The first record of the first file only.
    names = spark.read.csv(path, header=True, inferSchema=False, encoding=encoding, **options).columns
    found = records(lines).withColumn("text", F.regexp_replace("text", "\\r$", ""))
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), options)
    # Every file begins with its header. Records are stored once, since types and rows are read apart; a pass that does
    # not need the order leaves the sort out.
    body = found.filter("not leads and trim(text) <> ''").select("file", "block", "id", cells.alias("cells"))
    stored = materialize(body, "records").orderBy("file", "block", "id")
    return stored.select(*[F.col(f"cells.c{i}").alias(n) for i, n in enumerate(names)])


def read_csv(
    spark: SparkSession,
    path: str,
    infer_types: bool = True,
    multi_line: bool | None = None,
    missing: list[str] | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """Scan with header. Without ``infer_types`` all columns are text.

    Cells equal to a word of ``missing`` (default MISSING) are NULL. Where some line has an odd number of quotes,
    lines are joined to records over many tasks. ``multi_line`` leaves line breaks inside quotes to Spark's own
    reader, which takes each such file in one task and without an extra pass if ``encoding`` is given too;
    switched off for a file that has them it is an error.
    """
    if multi_line is None or encoding is None or not multi_line:
        found, broken = _facts(spark, path)
        encoding = encoding or found
        if broken and multi_line is False:
            raise ValueError(f"{path} has line breaks inside quotes; read it with multi_line")
    else:
        broken = False
    if broken and not multi_line:
        df = _quoted_lines(spark, path, encoding)
    else:
        whole = bool(multi_line)
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=whole, encoding=encoding, quote='"', escape='"')
    words = MISSING if missing is None else missing
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*words), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return with_types(df) if infer_types else df

