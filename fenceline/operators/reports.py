"""The reading side: lists, summaries, charts and drill-downs."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fenceline.functions.quantiles import array_quantile
from fenceline.functions.summary import side_by_side
from fenceline.settings import INCIDENT_STATUSES, DetectionSettings

UNRESOLVED = "status <> 'resolved'"
# Upper bounds of the severity buckets.
SEVERITY_BUCKETS = (("Low", 30), ("Medium", 60), ("High", 80), ("Critical", None))
HIGH_SEVERITY = 70
BOXPLOT_MIN_ROWS = 5


# --- incidents ---------------------------------------------------------------------------------


def filter_incidents(
    incidents: DataFrame,
    status: str | None = None,
    min_severity: float | None = None,
    store_id: str | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
) -> DataFrame:
    if status:
        if status.lower() not in INCIDENT_STATUSES:
            raise ValueError(f"Invalid status: {status}")
        incidents = incidents.filter(F.col("status") == status.lower())
    if min_severity is not None:
        incidents = incidents.filter(F.col("severity_score") >= min_severity)
    if store_id:
        incidents = incidents.filter(F.col("store_id") == store_id)
    if date_from:
        incidents = incidents.filter(F.col("date") >= F.lit(date_from))
    if date_to:
        incidents = incidents.filter(F.col("date") <= F.lit(date_to))
    return incidents


def incident_page(incidents: DataFrame, page: int = 1, page_size: int = 20, **filters) -> DataFrame:
    """One page, most severe first, then newest, then by id."""
    return (
        filter_incidents(incidents, **filters)
        .orderBy(F.desc("severity_score"), F.desc("date"), "incident_id")
        .offset((page - 1) * page_size)
        .limit(page_size)
    )


def page_cursor(page: DataFrame) -> tuple | None:
    """Place of the last incident of a page in the order of pages; None for an empty page."""
    last = page.orderBy("severity_score", "date", F.desc("incident_id")).select("severity_score", "date", "incident_id").first()
    return tuple(last) if last else None


def incident_page_after(incidents: DataFrame, cursor: tuple | None, page_size: int = 20, **filters) -> DataFrame:
    """The incidents behind a place, however deep: what lies before it is filtered in the scan, and only one page of each
    task is sorted and sent on. ``None`` is the place before all."""
    rows = filter_incidents(incidents, **filters)
    if cursor:
        severity, date, incident_id = (F.lit(v) for v in cursor)
        same_day = (F.col("date") == date) & (F.col("incident_id") > incident_id)
        same_severity = (F.col("severity_score") == severity) & ((F.col("date") < date) | same_day)
        # The first condition alone reaches the scan.
        rows = rows.filter(F.col("severity_score") <= severity).filter((F.col("severity_score") < severity) | same_severity)
    return rows.orderBy(F.desc("severity_score"), F.desc("date"), "incident_id").limit(page_size)


def page_totals(rows: DataFrame, page_size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.ceil(total / page_size).alias("pages"))


def status_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("status").agg(F.count(F.lit(1)).alias("incidents"))


def incident_summary(incidents: DataFrame) -> DataFrame:
    """Headline numbers over unresolved incidents, in one pass."""
    unresolved = F.col("status") != "resolved"
    return incidents.agg(
        F.count_if((F.col("severity_score") >= HIGH_SEVERITY) & unresolved).alias("high_severity_count"),
        F.count_distinct(F.when(unresolved, F.col("store_id"))).alias("affected_stores"),
        F.coalesce(F.sum(F.when(unresolved, F.col("sku_count"))), F.lit(0)).alias("affected_skus"),
        F.round(F.coalesce(F.sum(F.when(unresolved, F.col("estimated_impact"))), F.lit(0.0)), 2).alias(
            "total_estimated_impact"
        ),
        F.count_if(F.col("status").isin("open", "investigating")).alias("active_incidents"),
    )


def incidents_over_time(incidents: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    since = as_of - dt.timedelta(days=days)
    return (
        incidents.filter(F.col("date") >= F.lit(since))
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("incidents"))
        .orderBy("date")
    )


def severity_distribution(incidents: DataFrame) -> DataFrame:
    """Four buckets, zero where empty: each is a conditional count of the same single pass."""
    lower, counts = 0, []
    score = F.col("severity_score")
    for name, upper in SEVERITY_BUCKETS:
        inside = score >= lower if lower else F.lit(True)
        inside = inside & (score < upper) if upper else inside
        counts.append(F.count_if(inside).alias(name))
        lower = upper
    wide = incidents.agg(*counts)
    return wide.unpivot([], [name for name, _ in SEVERITY_BUCKETS], "bucket", "incidents")


def top_stores(incidents: DataFrame, limit: int = 10) -> DataFrame:
    return (
        incidents.filter(UNRESOLVED)
        .groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("incident_count"))
        .orderBy(F.desc("incident_count"), "store_id")
        .limit(limit)
    )


def incident_detail(incidents: DataFrame, items: DataFrame, notes: DataFrame) -> DataFrame:
    """Incidents with their items and notes as rows: ``section`` is incident, item or note.

    One row per child instead of nested lists, so an incident with very many items stays spread out
    and items do not multiply with notes. Order by (incident_id, section, position) to display:
    items by SKU, notes newest first.
    """
    item_rows = items.join(incidents.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id",
        F.lit("item").alias("section"),
        F.col("sku_id").alias("position"),
        F.array_join("detection_result_ids", ",").alias("content"),
        F.lit(None).cast("string").alias("author"),
        F.col("contribution_score").alias("amount"),
    )
    note_rows = notes.join(incidents.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id",
        F.lit("note").alias("section"),
        # Counts down, so that text order is newest first.
        F.lpad((F.lit(10**12) - F.unix_seconds("created_at")).cast("string"), 13, "0").alias("position"),
        "content",
        "author",
        F.lit(None).cast("double").alias("amount"),
    )
    head = incidents.select(
        "incident_id",
        F.lit("incident").alias("section"),
        F.lit("").alias("position"),
        F.col("headline").alias("content"),
        F.col("assignee").alias("author"),
        F.col("severity_score").alias("amount"),
    )
    return head.unionByName(item_rows).unionByName(note_rows)


def detection_details(items: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections behind each incident item, one row per detection.

    The ids lead to the rows; date, store and SKU are joined as well, so the join is spread by key.
    """
    ids = items.select("incident_id", "date", "store_id", "sku_id", F.explode("detection_result_ids").alias("detection_id"))
    return ids.join(detections, ["date", "store_id", "sku_id", "detection_id"]).select(
        "incident_id",
        "date",
        "store_id",
        "sku_id",
        "detector_type",
        "metric_name",
        "actual_value",
        "q1",
        "q3",
        "iqr",
        "lower_fence",
        "upper_fence",
        "outlier_distance",
        "sample_size",
        "fallback_used",
        "anomaly_score",
        "threshold_used",
        "reasons",
    )


# --- series ------------------------------------------------------------------------------------


def _period(rows, store_id, sku_id, date_from, date_to):
    if store_id:
        rows = rows.filter(F.col("store_id") == store_id)
    if sku_id:
        rows = rows.filter(F.col("sku_id") == sku_id)
    if date_from:
        rows = rows.filter(F.col("date") >= F.lit(date_from))
    if date_to:
        rows = rows.filter(F.col("date") <= F.lit(date_to))
    return rows


def _with_change(rows: DataFrame) -> DataFrame:
    """Change of on_hand since the previous row inside the chosen period."""
    pair = Window.partitionBy("store_id", "sku_id").orderBy("date")
    return rows.withColumn("delta_on_hand", F.col("on_hand") - F.lag("on_hand").over(pair))


def timeseries(
    raw: DataFrame, detections: DataFrame, as_of: dt.date, store_id=None, sku_id=None, date_from=None, date_to=None, days: int = 90
) -> DataFrame:
    """sold, on_hand and delta_on_hand points with outlier marks (on_hand is marked by its delta)."""
    date_to = date_to or as_of
    date_from = date_from or date_to - dt.timedelta(days=days)
    key = ["store_id", "sku_id", "date"]
    marks = (
        _period(detections, store_id, sku_id, date_from, date_to)
        .filter("is_outlier and metric_name is not null")
        .groupBy(*key)
        .agg(
            F.bool_or(F.col("metric_name") == "sold").alias("sold_mark"),
            F.bool_or(F.col("metric_name") == "delta_on_hand").alias("delta_mark"),
        )
    )
    rows = _with_change(_period(raw, store_id, sku_id, date_from, date_to)).join(marks, key, "left")

    def point(metric, mark):
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
            F.coalesce(mark, F.lit(False)).alias("is_outlier"),
        )

    points = F.array(
        point("sold", F.col("sold_mark")),
        point("on_hand", F.col("delta_mark")),
        point("delta_on_hand", F.col("delta_mark")),
    )
    return rows.select(*key, F.inline(points)).filter("value is not null")


def boxplot(
    raw: DataFrame, as_of: dt.date, settings: DetectionSettings, store_id=None, sku_id=None, date_from=None, date_to=None, days: int = 28
) -> DataFrame:
    """Five numbers, fences and outlying values of sold and delta_on_hand, for every pair at once.

    A pair's values in the period are at most one per day, so the sorted array is calendar-bounded.
    Pairs with fewer than five rows are left out.
    """
    date_to = date_to or as_of
    date_from = date_from or date_to - dt.timedelta(days=days)
    rows = _with_change(_period(raw, store_id, sku_id, date_from, date_to))
    point = [
        F.struct(F.lit(m).alias("metric"), F.col("date"), F.col(m).cast("double").alias("value"))
        for m in ("sold", "delta_on_hand")
    ]
    values = (
        rows.select("store_id", "sku_id", F.inline(F.array(*point)))
        .groupBy("store_id", "sku_id", "metric")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.collect_list(F.when(F.col("value").isNotNull(), F.struct("date", "value"))).alias("points"),
        )
        .filter((F.col("rows") >= BOXPLOT_MIN_ROWS) & (F.size("points") > 0))
        .withColumn("v", F.sort_array(F.transform("points", lambda p: p["value"])))
    )
    stats = values.select(
        "store_id",
        "sku_id",
        "metric",
        "points",
        F.get("v", F.lit(0)).alias("min"),
        array_quantile(F.col("v"), 0.25).alias("q1"),
        array_quantile(F.col("v"), 0.5).alias("median"),
        array_quantile(F.col("v"), 0.75).alias("q3"),
        F.element_at("v", -1).alias("max"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    k = settings.fence_factor
    fenced = stats.withColumn("lower_fence", F.col("q1") - k * F.col("iqr")).withColumn(
        "upper_fence", F.col("q3") + k * F.col("iqr")
    )
    outside = F.filter(
        F.transform(F.sort_array("points"), lambda p: p["value"]),
        lambda x: (x < F.col("lower_fence")) | (x > F.col("upper_fence")),
    )
    return fenced.withColumn("flags", outside).drop("points")


def list_stores(raw: DataFrame) -> DataFrame:
    return raw.select("store_id").distinct().orderBy("store_id")


def list_skus(raw: DataFrame, store_id: str | None = None) -> DataFrame:
    rows = raw.filter(F.col("store_id") == store_id) if store_id else raw
    return rows.select("sku_id").distinct().orderBy("sku_id")


# --- whole tables --------------------------------------------------------------------------------


def detection_mode(raw: DataFrame) -> DataFrame:
    """Which of stock and sales are present in more than a tenth of the rows, and what to test."""
    counts = raw.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("on_hand").alias("has_on_hand"),
        F.count_if(F.col("sold") > 0).alias("has_sold"),
    )
    stock = F.col("has_on_hand") > F.col("total") * 0.1
    sales = F.col("has_sold") > F.col("total") * 0.1
    mode = (
        F.when(F.col("total") == 0, "none")
        .when(stock & sales, "full")
        .when(sales, "sold_only")
        .when(stock, "on_hand_only")
        .otherwise("none")
    )
    metrics = F.concat_ws(
        ",",
        F.when(F.col("mode").isin("full", "sold_only"), "sold"),
        F.when(F.col("mode").isin("full", "on_hand_only"), "delta_on_hand"),
    )
    return counts.withColumn("mode", mode).withColumn("metrics", metrics)


def date_spine(raw: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last date."""
    ends = raw.agg(F.min("date").alias("a"), F.max("date").alias("b")).filter("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("date"))


def duplicate_keys(raw: DataFrame) -> DataFrame:
    """(date, store, SKU) keys that occur more than once; must be empty before detection."""
    return raw.groupBy("date", "store_id", "sku_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def data_stats(datasets: DataFrame, data_rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Two rows, ``datasets`` and ``daily``: sizes and date ranges of the stored data."""
    sets = datasets.agg(
        F.count(F.lit(1)).alias("datasets"),
        F.min("date_range_start").alias("date_from"),
        F.max("date_range_end").alias("date_to"),
    )
    size = data_rows.agg(F.count(F.lit(1)).alias("rows"))
    daily = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("sku_id").alias("skus"),
        F.min("date").alias("date_from"),
        F.max("date").alias("date_to"),
    )
    flexible = side_by_side(sets, size)
    return flexible.withColumn("part", F.lit("datasets")).unionByName(
        daily.withColumn("part", F.lit("daily")), allowMissingColumns=True
    )
