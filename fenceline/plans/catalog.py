"""The registered queries: each takes (spark, table folder) and returns a flat DataFrame.

Output columns are plain strings, bigints, doubles and booleans, so that any engine can compare them.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.functions.parsing import parse_date, parse_number
from fenceline.functions.quantiles import histogram_quantiles
from fenceline.functions.summary import side_by_side
from fenceline.operators import features as feat
from fenceline.operators import flexible as flex
from fenceline.operators import forest
from fenceline.operators import incidents as inc
from fenceline.operators import ingest
from fenceline.operators import profile as prof
from fenceline.operators import reports as rep
from fenceline.operators import tukey
from fenceline.operators import workflow as work
from fenceline.operators.detections import forest_detections, tukey_detections
from fenceline.plans import fixtures, history
from fenceline.plans.daily import run_range, store_run
from fenceline.plans.flexible import analyze_csv
from fenceline.settings import DEFAULTS
from fenceline.sources import datasets
from fenceline.sources.csv import read_csv
from fenceline.sources.shared import materialize, new_path
from fenceline.sources.versioned import VersionedTables

QUERIES = {}
HALF_WAY = dt.date(1998, 6, 30)
CHANGES_FROM = dt.datetime(2002, 2, 1, tzinfo=dt.timezone.utc)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame, rounded: int | None = None, nudge: float = 0.0) -> DataFrame:
    """Dates as ISO text, whole numbers as bigint, decimals as (optionally rounded) double.

    ``nudge`` is added before rounding where exact ties are common, so that noise in the last bit
    cannot send the two engines to different sides of a tie.
    """
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "double" and rounded is not None:
            c = F.round(c + nudge if nudge else c, rounded)
        out.append(c.alias(name))
    return df.select(*out)


# --- stored tables -------------------------------------------------------------------------------
# The reading side works on stored detections and incidents, as it would in production. Each table is
# built once per session and table folder; the queries that produce them do not use these copies.

_STORED = {}
AS_OF = dt.datetime(2002, 1, 1, tzinfo=dt.timezone.utc)


def as_of():
    return F.lit(AS_OF)


def stored(spark, sf_dir, name):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = materialize(_BUILD[name](spark, sf_dir), name)
    return _STORED[key]


def _features(spark, sf_dir):
    return feat.daily_features(fixtures.raw_daily(spark, sf_dir))


def _incidents_in_use(spark, sf_dir):
    """Incidents part way through their life: the state follows from the first hex digit of the key."""
    digit = F.left("dedup_key", F.lit(1))
    status = (
        F.when(digit.isin(list("abcd")), "investigating").when(digit.isin(list("ef")), "resolved").otherwise("open")
    )
    fresh = inc.new_incidents(stored(spark, sf_dir, "run"), as_of())
    return fresh.withColumn("status", status).withColumn(
        "resolved_at", F.when(F.col("status") == "resolved", F.col("created_at"))
    )


_BUILD = {
    "features": _features,
    "tukey": lambda s, d: tukey.tukey_results(stored(s, d, "features")),
    "detections": lambda s, d: tukey_detections(stored(s, d, "tukey")),
    "flagged": lambda s, d: inc.flagged_rows(stored(s, d, "detections"), stored(s, d, "features")),
    "groups": lambda s, d: inc.incident_groups(stored(s, d, "flagged")),
    "run": lambda s, d: inc.run_incidents(stored(s, d, "groups")),
    "incidents": _incidents_in_use,
    "items": lambda s, d: inc.incident_items(
        stored(s, d, "run"), stored(s, d, "flagged"), stored(s, d, "detections")
    ),
}


def _labelled(results):
    return results.withColumn("fallback_used", F.coalesce("fallback_used", F.lit("pair")))


# --- detection -----------------------------------------------------------------------------------


@query
def features_daily(spark, sf_dir):
    df = _features(spark, sf_dir).drop("day_number", "prev_day_number")
    return flat(df.withColumn("delta_on_hand", F.col("delta_on_hand").cast("double")), 6)


@query
def tukey_results(spark, sf_dir):
    return flat(_labelled(tukey.tukey_results(_features(spark, sf_dir))))


@query
def tukey_results_sparse(spark, sf_dir):
    """Many stores and SKUs: nearly every target needs a coarser baseline."""
    raw = fixtures.raw_daily(spark, sf_dir, stores=400, skus=300)
    return flat(_labelled(tukey.tukey_results(feat.daily_features(raw))))


@query
def tukey_levels(spark, sf_dir):
    """How many targets each baseline level serves, per metric."""
    results = _labelled(tukey.tukey_results(_features(spark, sf_dir)))
    return results.groupBy("metric_name", "fallback_used").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("is_outlier").alias("flagged")
    )


@query
def tukey_fences(spark, sf_dir):
    """Fences of each pair over its whole history."""
    sold = F.col("sold").cast("double")
    hist = fixtures.raw_daily(spark, sf_dir).groupBy("store_id", "sku_id", sold.alias("value")).agg(
        F.count(F.lit(1)).alias("w")
    )
    keys = ["store_id", "sku_id"]
    quartiles = histogram_quantiles(hist, keys, "value", "w", tukey.QUARTILES, ("q1", "q3"))
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *keys,
        F.col("n").alias("sample_size"),
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - DEFAULTS.fence_factor * iqr).alias("lower_fence"),
        (F.col("q3") + DEFAULTS.fence_factor * iqr).alias("upper_fence"),
    )


@query
def tukey_reasons(spark, sf_dir):
    told = tukey.tukey_reasons(tukey.tukey_results(_features(spark, sf_dir)).filter("is_outlier"))
    return flat(
        told.select("date", "store_id", "sku_id", "metric_name", "reason.type", "reason.message", "reason.distance")
    )


# --- incidents -----------------------------------------------------------------------------------


@query
def incident_groups(spark, sf_dir):
    groups = inc.incident_groups(stored(spark, sf_dir, "flagged"))
    return flat(groups.select("date", "store_id", "sku_count", "estimated_impact"), 4)


@query
def incident_severity(spark, sf_dir):
    groups = inc.incident_groups(stored(spark, sf_dir, "flagged"))
    return flat(groups.select("date", "store_id", "severity_score"), 6)


@query
def incident_dedup(spark, sf_dir):
    return flat(inc.incident_groups(stored(spark, sf_dir, "flagged")).select("date", "store_id", "dedup_key"))


@query
def incident_headline(spark, sf_dir):
    return flat(inc.incident_groups(stored(spark, sf_dir, "flagged")).select("date", "store_id", "headline"))


@query
def incident_description(spark, sf_dir):
    return flat(inc.incident_groups(stored(spark, sf_dir, "flagged")).select("date", "store_id", "description"))


@query
def incidents(spark, sf_dir):
    """From daily rows to incidents in one go (fences only)."""
    features = materialize(_features(spark, sf_dir), "features")
    detections = tukey_detections(tukey.tukey_results(features))
    flagged = materialize(inc.flagged_rows(detections, features), "flagged")
    run = inc.run_incidents(inc.incident_groups(flagged))
    made = inc.new_incidents(run, as_of())
    return flat(
        made.select(
            "incident_id",
            "date",
            "store_id",
            "status",
            "severity_score",
            "headline",
            "description",
            "sku_count",
            "estimated_impact",
            F.array_join("detectors_triggered", ",").alias("detectors_triggered"),
        ),
        4,
    )


def _planted_forest(features):
    """Results in the shape of the forest's: which rows are flagged, and why, follows from their values."""
    told = F.struct(
        F.lit("price").alias("feature"),
        F.lit(2.0).alias("z_score"),
        F.lit("price is 2.0 std above average").alias("message"),
        F.col("price").alias("value"),
        F.lit(1.0).alias("mean"),
    )
    return features.filter((F.col("sold") + F.col("day_number")) % 50 == 0).select(
        "date",
        "store_id",
        "sku_id",
        F.lit(-0.1).alias("anomaly_score"),
        F.lit(True).alias("is_anomaly"),
        F.lit(DEFAULTS.contamination).alias("threshold_used"),
        F.when(F.col("sold") % 2 == 0, F.array(told)).otherwise(F.slice(F.array(told), 1, 0)).alias("reasons"),
        F.lit("global").alias("fallback_used"),
    )


@query
def incidents_both_detectors(spark, sf_dir):
    """From daily rows to incidents of fences and (planted) forest flags."""
    features = stored(spark, sf_dir, "features")
    both = tukey_detections(stored(spark, sf_dir, "tukey")).unionByName(forest_detections(_planted_forest(features)))
    detections = materialize(both, "detections")
    flagged = materialize(inc.flagged_rows(detections, features), "flagged")
    run = materialize(inc.run_incidents(inc.incident_groups(flagged)), "run")
    items = inc.incident_items(run, flagged, detections).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("detection_result_ids")).alias("item_detections")
    )
    made = inc.new_incidents(run, as_of()).join(items, "incident_id")
    return flat(
        made.select(
            "incident_id",
            "date",
            "store_id",
            "severity_score",
            "headline",
            "description",
            "sku_count",
            "estimated_impact",
            F.array_join("detectors_triggered", ",").alias("detectors_triggered"),
            "items",
            "item_detections",
        ),
        4,
    )


RERUN = (dt.date(1998, 3, 1), dt.date(1998, 6, 30))


@query
def versioned_rerun(spark, sf_dir):
    """Detections per month before and after a span was run again without the 7th and 8th of its months."""
    tables = VersionedTables(spark, new_path(spark, "versioned"))
    raw = materialize(fixtures.raw_daily(spark, sf_dir), "raw")
    everything = (dt.date(1980, 1, 1), dt.date(2020, 12, 31))
    store_run(tables, run_range(tables, raw, as_of(), *everything), *everything)
    again = raw.filter(~F.dayofmonth("date").isin(7, 8))
    store_run(tables, run_range(tables, again, as_of(), *RERUN), *RERUN)
    versions = [tables.read("detections", version=v).withColumn("version", F.lit(v)) for v in (1, 2)]
    month = F.date_format("date", "yyyy-MM")
    return flat(
        versions[0]
        .unionByName(versions[1])
        .groupBy("version", month.alias("month"), "metric_name")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.countDistinct("date").alias("dates"),
            F.count_if("is_outlier").alias("flagged"),
            F.sum("sample_size").alias("sample_size"),
        )
    )


@query
def incident_merge(spark, sf_dir):
    """A rerun meets a table that holds the older half of the incidents."""
    earlier = stored(spark, sf_dir, "incidents").filter(F.col("date") < F.lit(HALF_WAY)).withColumn(
        "severity_score", F.lit(1.0)
    )
    merged = inc.merge_incidents(earlier, stored(spark, sf_dir, "run"), as_of())
    return flat(merged.select("incident_id", "date", "status", "severity_score", "sku_count", "change"), 4)


@query
def incident_history(spark, sf_dir):
    """The same rerun against a table in buckets, which is not shuffled."""
    earlier = stored(spark, sf_dir, "incidents").filter(F.col("date") < F.lit(HALF_WAY)).withColumn(
        "severity_score", F.lit(1.0)
    )
    old, new = new_path(spark, "history"), new_path(spark, "history")
    history.store_incidents(earlier, old)
    merged = history.merge_run(spark, old, stored(spark, sf_dir, "run"), as_of(), new)
    return flat(merged.select("incident_id", "date", "status", "severity_score", "sku_count"), 4)


@query
def incident_items(spark, sf_dir):
    items = inc.incident_items(
        stored(spark, sf_dir, "run"), stored(spark, sf_dir, "flagged"), stored(spark, sf_dir, "detections")
    )
    return flat(
        items.select(
            "incident_id",
            "sku_id",
            "contribution_score",
            F.array_join("detection_result_ids", ",").alias("detection_result_ids"),
        ),
        6,
    )


@query
def incident_notes(spark, sf_dir):
    notes = inc.creation_notes(stored(spark, sf_dir, "run"), as_of())
    return flat(notes.select("incident_id", "author", "content", "note_type"))


@query
def run_stats(spark, sf_dir):
    """Counts of one run without the forest."""
    features, results = stored(spark, sf_dir, "features"), stored(spark, sf_dir, "tukey")
    return side_by_side(
        features.agg(F.count(F.lit(1)).alias("features_created")),
        results.agg(F.count_if("is_outlier").alias("tukey_flags")),
        inc.run_counts(stored(spark, sf_dir, "run")),
        rep.detection_mode(features).select("mode"),
    )


# --- reports -------------------------------------------------------------------------------------


@query
def incident_list(spark, sf_dir):
    page = rep.incident_page(
        stored(spark, sf_dir, "incidents"),
        page=2,
        page_size=20,
        status="OPEN",
        min_severity=40,
        date_from=dt.date(1996, 1, 1),
        date_to=dt.date(2001, 6, 30),
    )
    return flat(page.select("incident_id", "date", "store_id", "status", "severity_score", "headline"), 4)


@query
def incident_list_next(spark, sf_dir):
    """The page behind the last incident of the page before, found by its place and not by counting."""
    table, wanted = stored(spark, sf_dir, "incidents"), {"status": "open", "min_severity": 40}
    last = rep.page_cursor(rep.incident_page(table, page=1, page_size=20, **wanted))
    page = rep.incident_page_after(table, last, page_size=20, **wanted)
    return flat(page.select("incident_id", "date", "store_id", "severity_score"), 4)


@query
def incident_total(spark, sf_dir):
    rows = rep.filter_incidents(stored(spark, sf_dir, "incidents"), status="open", min_severity=40)
    return flat(rep.page_totals(rows, 20))


@query
def status_counts(spark, sf_dir):
    return rep.status_counts(stored(spark, sf_dir, "incidents"))


@query
def incident_summary(spark, sf_dir):
    return rep.incident_summary(stored(spark, sf_dir, "incidents"))


@query
def incidents_over_time(spark, sf_dir):
    return flat(rep.incidents_over_time(stored(spark, sf_dir, "incidents"), AS_OF.date(), days=365))


@query
def severity_distribution(spark, sf_dir):
    return rep.severity_distribution(stored(spark, sf_dir, "incidents"))


@query
def top_stores(spark, sf_dir):
    return rep.top_stores(stored(spark, sf_dir, "incidents"), 3)


@query
def incident_detail(spark, sf_dir):
    notes = inc.creation_notes(stored(spark, sf_dir, "run"), as_of())
    detail = rep.incident_detail(stored(spark, sf_dir, "incidents"), stored(spark, sf_dir, "items"), notes)
    return flat(detail, 4)


@query
def detection_details(spark, sf_dir):
    details = rep.detection_details(stored(spark, sf_dir, "items"), stored(spark, sf_dir, "detections"))
    return flat(_labelled(details).drop("anomaly_score", "threshold_used", "reasons", "date"))


@query
def apply_changes(spark, sf_dir):
    table = stored(spark, sf_dir, "incidents")
    changed = work.apply_changes(table, _change_log(table))
    seconds = (F.unix_seconds("resolved_at") - int(CHANGES_FROM.timestamp())).cast("double")
    return flat(
        changed.select(
            "incident_id", "status", "assignee", "resolution_reason", seconds.alias("resolved_after")
        )
    )


@query
def audit_notes(spark, sf_dir):
    table = stored(spark, sf_dir, "incidents")
    notes = work.audit_notes(table, _change_log(table))
    comments = table.filter(F.col("status") == "open").select(
        "incident_id",
        F.lit(None).cast("string").alias("author"),
        F.concat(F.lit("Looked at "), "headline").alias("content"),
        as_of().alias("created_at"),
    )
    said = work.comment_notes(table, comments).withColumn("change_id", F.lit(0))
    columns = ["incident_id", "change_id", "author", "content", "note_type"]
    return flat(notes.select(*columns).unionByName(said.select(*columns)))


@query
def rejected_changes(spark, sf_dir):
    table = stored(spark, sf_dir, "incidents")
    return work.invalid_changes(_change_log(table)).select("incident_id", F.col("change_id").cast("bigint").alias("change_id"), "status")


def _change_log(table):
    """Three requests per incident an hour and a half apart, derived from the digits of its id."""

    def digit(i):
        return F.substring("incident_id", i, 1)

    def request(number):
        status = (
            F.when(digit(number + 1).isin(list("0123")), "Investigating")
            .when(digit(number + 1).isin(list("4567")), "resolved")
            .when(digit(number + 1).isin(list("89")), "open")
            .when(digit(number + 1) == "f", "bogus")
        )
        assignee = F.when(digit(number + 4).isin(list("0123")), F.concat(F.lit("user-"), digit(number + 7))).when(
            digit(number + 4) == "4", F.lit("")
        )
        reason = F.when(digit(number + 10) == "0", F.lit("checked"))
        at = F.lit(CHANGES_FROM) + F.expr(f"interval {90 * number} minutes")
        return F.struct(
            F.lit(number).alias("change_id"),
            at.alias("changed_at"),
            status.alias("status"),
            assignee.alias("assignee"),
            reason.alias("resolution_reason"),
        )

    return table.select("incident_id", F.inline(F.array(*[request(i) for i in (1, 2, 3)])))


@query
def timeseries(spark, sf_dir):
    points = rep.timeseries(
        fixtures.raw_daily(spark, sf_dir),
        stored(spark, sf_dir, "detections"),
        HALF_WAY,
        store_id="ST-001",
        days=365,
    )
    return flat(points)


@query
def boxplot(spark, sf_dir):
    box = rep.boxplot(fixtures.raw_daily(spark, sf_dir), HALF_WAY, DEFAULTS, days=90)
    told = F.array_join(F.transform("flags", lambda x: x.cast("bigint").cast("string")), ",")
    return flat(box.withColumn("flags", told))


@query
def list_stores(spark, sf_dir):
    return rep.list_stores(fixtures.raw_daily(spark, sf_dir))


@query
def list_skus(spark, sf_dir):
    return rep.list_skus(fixtures.raw_daily(spark, sf_dir), "ST-003")


@query
def detection_mode(spark, sf_dir):
    return rep.detection_mode(fixtures.raw_daily(spark, sf_dir))


@query
def date_spine(spark, sf_dir):
    return flat(rep.date_spine(fixtures.raw_daily(spark, sf_dir)))


@query
def duplicate_keys(spark, sf_dir):
    """Line items of one supplier and part on one day, before they are summed into daily rows."""
    lines = fixtures.table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").cast("string").alias("store_id"),
        (F.col("l_partkey") % 100).cast("string").alias("sku_id"),
    )
    return flat(rep.duplicate_keys(lines))


# --- forest --------------------------------------------------------------------------------------


def _baseline(spark, sf_dir):
    return feat.feature_baseline(_features(spark, sf_dir))


@query
def feature_baseline(spark, sf_dir):
    df = _baseline(spark, sf_dir)
    stats = [f"{name}_{stat}" for name in feat.REASON_FEATURES for stat in ("mean", "std")]
    return flat(df.select("date", "store_id", "sku_id", "baseline_rows", *stats), 5, 1e-8)


@query
def forest_features(spark, sf_dir):
    return flat(forest.forest_features(_features(spark, sf_dir)).drop("day_number"))


@query
def forest_training_counts(spark, sf_dir):
    counts = forest.training_counts(_features(spark, sf_dir))
    return flat(counts.withColumn("date", F.date_from_unix_date("day_number")).drop("day_number", "day_rows"))


@query
def forest_scope(spark, sf_dir):
    features = _features(spark, sf_dir)
    scoped = forest.with_scope(features, materialize(forest.cutoffs(features), "forest-cutoffs"))
    return flat(scoped.select("date", "store_id", "sku_id", F.coalesce("scope", F.lit("none")).alias("scope")))


@query
def forest_reasons(spark, sf_dir):
    """The features that stand out, per daily row and rank."""
    told = _baseline(spark, sf_dir)
    found = told.select("date", "store_id", "sku_id", F.posexplode(forest.notable_z(told)).alias("rank", "r"))
    return flat(found.select("date", "store_id", "sku_id", "rank", "r.feature", "r.value", "r.mean", "r.z"), 4, 1e-8)


@query
def forest_model(spark, sf_dir):
    """Sample of every tree of every scope, and whether its nodes make a binary tree over it."""
    features = stored(spark, sf_dir, "features")
    cuts = materialize(forest.cutoffs(features), "forest-cutoffs")
    training = forest.training_rows(forest.forest_features(features), cuts)
    trees = forest.fit_forest(training, forest.FEATURES, cuts.count())
    nodes = F.size("feature")
    # Every split has two sides, and no leaf is empty.
    whole = (nodes % 2 == 1) & (nodes <= 2 * F.col("sample_size") - 1)
    return flat(trees.select("scope", "tree", "sample_size", whole.alias("whole")))


@query
def forest_results(spark, sf_dir):
    baseline = materialize(_baseline(spark, sf_dir), "feature-baseline")  # carries the features too
    results = forest.forest_results(baseline)
    score, label = F.col("anomaly_score"), F.coalesce("fallback_used", F.lit("store"))
    fits = score.between(-1, 1) & (F.col("is_anomaly") == (score < 0))
    return flat(
        results.select(
            "date",
            "store_id",
            "sku_id",
            fits.alias("score_fits"),
            "threshold_used",
            F.array_join(F.transform("reasons", lambda r: r["feature"]), ",").alias("reasons"),
            label.alias("fallback_used"),
        )
    )


@query
def forest_shares(spark, sf_dir):
    """How many rows each kind of model judges; the flagged share stays near the expected one."""
    results = forest.forest_results(materialize(_baseline(spark, sf_dir), "feature-baseline"))
    share = F.count_if("is_anomaly") / F.count(F.lit(1))
    none, low, high = F.col("label") == "insufficient_data", DEFAULTS.contamination / 10, DEFAULTS.contamination * 4
    fits = F.when(none, F.col("share") == 0).otherwise(F.col("share").between(low, high))
    labelled = results.groupBy(F.coalesce("fallback_used", F.lit("store")).alias("label"))
    return labelled.agg(F.count(F.lit(1)).alias("rows"), share.alias("share")).select("label", "rows", fits.alias("share_fits"))


# --- flexible tables -------------------------------------------------------------------------------

EVENTS = ingest.DatasetSchema(
    1, "events", "day", ["event_type", "user_id"], ["value", "k"], ["props"]
)
ORDERS = ingest.DatasetSchema(2, "orders", "order_date", ["customer", "priority"], ["total"], ["status"])


def _event_rows(spark, sf_dir):
    rows = fixtures.flexible_events(spark, sf_dir).withColumnRenamed("day", "date")
    return rows.withColumn("identifier_key", ingest.identifier_key(EVENTS))


@query
def flexible_tukey(spark, sf_dir):
    found = flex.flexible_tukey(_event_rows(spark, sf_dir), EVENTS)
    return flat(found.drop("metric_order", "reason", "detector_type"), 6)


@query
def flexible_zscores(spark, sf_dir):
    return flat(flex.flexible_zscores(_event_rows(spark, sf_dir), EVENTS).drop("metric_order"), 6)


@query
def flexible_forest(spark, sf_dir):
    """Every complete row with its score checked; at most the expected share is flagged, and only those have reasons."""
    found = materialize(flex.flexible_forest(_event_rows(spark, sf_dir), EVENTS), "flexible-forest")
    share = found.agg(F.count_if("is_outlier") / F.count(F.lit(1))).first()[0]
    most = DEFAULTS.contamination
    score = F.col("anomaly_score")
    fits = score.between(-1, 1) & (F.col("is_outlier") == (score < 0)) & ((F.size("reasons") == 0) | F.col("is_outlier"))
    return flat(
        found.select(
            "row_id", "date", "identifier_key", "label", "detector_type", fits.alias("score_fits"),
            F.lit(most / 2 <= share <= most).alias("share_fits"),
        )
    )


@query
def flexible_detections(spark, sf_dir):
    """Flags per day and metric, over the table both detectors write into (fences only here)."""
    found = flex.flexible_detections(flex.flexible_tukey(_event_rows(spark, sf_dir), EVENTS), None)
    return flat(
        found.groupBy("date", "detector_type", "metric_name").agg(
            F.count(F.lit(1)).alias("results"), F.count_if("is_outlier").alias("flags")
        )
    )


@query
def flexible_incidents_both(spark, sf_dir):
    """Incidents of fences and (planted) forest flags, one per identifier."""
    rows = _event_rows(spark, sf_dir)
    reason = F.struct(F.lit("k").alias("feature"), F.lit(3.0).alias("z_score"), F.lit("k is 3.0 standard deviations from mean").alias("message"))
    planted = flex.with_label(rows, EVENTS).filter("value is not null and k is not null and row_id % 40 < 3").select(
        "row_id",
        "date",
        "identifier_key",
        "label",
        F.lit("isolation_forest").alias("detector_type"),
        F.lit(-0.1).alias("anomaly_score"),
        (F.col("row_id") % 40 < 2).alias("is_outlier"),
        F.when(F.col("row_id") % 40 == 0, F.array(reason)).otherwise(F.slice(F.array(reason), 1, 0)).alias("reasons"),
    )
    both = materialize(flex.flexible_detections(flex.flexible_tukey(rows, EVENTS), planted), "flexible-detections")
    run = flex.flexible_incidents(both, EVENTS, AS_OF.date())
    return flat(
        inc.new_incidents(run, as_of()).select(
            "incident_id",
            "date",
            "store_id",
            "severity_score",
            "headline",
            F.array_join(F.array_sort("detectors_triggered"), ",").alias("detectors_triggered"),
            F.regexp_replace("description", r"\[[^\]]*\]", "").alias("description"),
        )
    )


@query
def flexible_incidents(spark, sf_dir):
    tukey_only = materialize(flex.flexible_tukey(_event_rows(spark, sf_dir), EVENTS), "flexible-detections")
    run = flex.flexible_incidents(tukey_only, EVENTS, AS_OF.date())
    made = inc.new_incidents(run, as_of())
    return flat(
        made.select(
            "incident_id",
            "date",
            "store_id",
            "dataset_id",
            "status",
            "severity_score",
            "headline",
            "sku_count",
            "estimated_impact",
            F.array_join("detectors_triggered", ",").alias("detectors_triggered"),
            F.regexp_replace("description", r"\[[^\]]*\]", "").alias("description"),
        )
    )


# --- ingest --------------------------------------------------------------------------------------


def _cleaned(spark, sf_dir):
    return ingest.clean(fixtures.dirty_orders(spark, sf_dir), ORDERS)


@query
def csv_scan(spark, sf_dir):
    """Write the untidy orders as CSV, then scan them with inferred types."""
    path = new_path(spark, "orders-csv")
    fixtures.dirty_orders(spark, sf_dir).write.csv(path, header=True, quote='"', escape='"')
    scanned = read_csv(spark, path)
    ingest.require_columns(scanned, ORDERS)
    return flat(scanned.select("row_index", "order_date", "priority", "status", "total"))


@query
def csv_profile(spark, sf_dir):
    """Orders as a CSV with missing-value words, 0/1, numbers and quoted line breaks, read and profiled."""
    path = new_path(spark, "profile-csv")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        customer.alias("customer"),
        F.when(customer % 7 == 0, "NA").otherwise((key * 3).cast("string")).alias("quantity"),
        (key % 2).alias("urgent"),
        F.when(key % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("total"),
        F.when(key % 5 == 0, F.concat(F.lit("two\nlines "), key)).otherwise(F.concat(F.lit("plain "), key)).alias("remark"),
    ).write.csv(path, header=True, quote='"', escape='"')
    found = analyze_csv(spark, path).profile
    return found.select("column_name", "detected_type", "total_count", "null_count", "unique_count")


@query
def preview_rows(spark, sf_dir):
    return flat(ingest.preview_rows(fixtures.dirty_orders(spark, sf_dir), "row_index"))


@query
def parse_dates(spark, sf_dir):
    df = fixtures.dirty_orders(spark, sf_dir)
    return flat(df.select("row_index", "order_date", parse_date(F.col("order_date")).alias("parsed")))


@query
def parse_numbers(spark, sf_dir):
    df = fixtures.dirty_orders(spark, sf_dir)
    return flat(df.select("row_index", "total", parse_number(F.col("total")).alias("parsed")))


@query
def valid_rows(spark, sf_dir):
    return flat(ingest.valid_rows(_cleaned(spark, sf_dir)).drop("identifier_key"))


@query
def row_errors(spark, sf_dir):
    return flat(ingest.row_errors(_cleaned(spark, sf_dir)))


@query
def transform_summary(spark, sf_dir):
    return ingest.transform_summary(_cleaned(spark, sf_dir))


@query
def identifier_key(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("row_index", "identifier_key")


def _packed_orders(spark, sf_dir):
    return ingest.packed_rows(ingest.valid_rows(_cleaned(spark, sf_dir)), ORDERS)


def _packed_events(spark, sf_dir):
    return ingest.packed_rows(_event_rows(spark, sf_dir), EVENTS, "row_id")


def _shown(packed):
    """Maps as text, in the declared order of their keys."""
    return packed.withColumns({c: F.to_json(c) for c in ("identifiers", "metrics", "attributes") if c in packed.columns})


@query
def packed_rows(spark, sf_dir):
    return flat(_shown(_packed_orders(spark, sf_dir)))


@query
def dataset_page(spark, sf_dir):
    page = ingest.dataset_page(
        _packed_orders(spark, sf_dir), limit=50, offset=25, date_to=dt.date(1998, 1, 1)
    )
    return flat(page.select("row_id", "date", "identifier_key"))


@query
def dataset_page_next(spark, sf_dir):
    """The rows behind the 75th, found by its place."""
    rows, wanted = materialize(_packed_orders(spark, sf_dir), "packed"), {"date_to": dt.date(1998, 1, 1)}
    last = ingest.dataset_cursor(ingest.dataset_page(rows, limit=75, **wanted))
    page = ingest.dataset_page_after(rows, last, limit=50, **wanted)
    return flat(page.select("row_id", "date", "identifier_key"))


@query
def unique_identifiers(spark, sf_dir):
    return flat(_shown(ingest.unique_identifiers(_packed_events(spark, sf_dir))))


def _registry(spark, sf_dir):
    """Two datasets with the statistics of their rows."""
    registry = datasets.empty_registry(spark)
    for day, s in ((1, EVENTS), (2, ORDERS)):
        registry = datasets.create_dataset(
            registry,
            s.dataset_id,
            dt.datetime(2002, 1, day),
            name=s.name,
            date_column=s.date_column,
            identifier_columns=s.identifiers,
            metric_columns=s.metrics,
            attribute_columns=s.attributes,
        )
    both = _packed_events(spark, sf_dir).unionByName(_packed_orders(spark, sf_dir))
    return datasets.add_stats(registry, both), both


@query
def dataset_list(spark, sf_dir):
    """Newest first; one dataset's roles were changed after its rows came in."""
    registry, _ = _registry(spark, sf_dir)
    changed = datasets.update_schema(registry, 2, dt.datetime(2002, 1, 3), '{"name": "renamed", "metric_columns": []}')
    listed = datasets.list_datasets(changed)
    return flat(
        listed.select(
            "dataset_id",
            "name",
            "date_column",
            F.array_join("identifier_columns", ",").alias("identifier_columns"),
            F.array_join("metric_columns", ",").alias("metric_columns"),
            "row_count",
        )
    )


@query
def dataset_stats(spark, sf_dir):
    registry, _ = _registry(spark, sf_dir)
    return flat(registry.select("dataset_id", "row_count", "date_range_start", "date_range_end"))


@query
def data_stats(spark, sf_dir):
    registry, rows = _registry(spark, sf_dir)
    stats = rep.data_stats(registry, rows, fixtures.raw_daily(spark, sf_dir))
    return flat(stats.withColumns({c: F.col(c).cast("double") for c in ("datasets", "stores", "skus")}))


# --- profiling -----------------------------------------------------------------------------------


def _text_cells(spark, sf_dir):
    return prof.cells(fixtures.dirty_orders(spark, sf_dir), "row_index")


@query
def profile_columns(spark, sf_dir):
    values = materialize(prof.value_counts(_text_cells(spark, sf_dir)), "values")
    counts = prof.summary(values)
    samples = prof.sample_values(values).withColumn("sample_values", F.array_join("sample_values", "|"))
    return flat(
        counts.join(samples.select("ordinal", "sample_values"), "ordinal")
        .select("ordinal", "column_name", "total_count", "null_count", "unique_count", "cardinality_ratio", "sample_values"),
        9,
    )


@query
def profile_numeric(spark, sf_dir):
    lines = fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    return flat(prof.numeric_stats(lines, "l_orderkey"), 4)


@query
def detect_types(spark, sf_dir):
    types = prof.detect_types(prof.column_counts(_text_cells(spark, sf_dir)))
    return types.select("column_name", "detected_type")


def _roles(spark, sf_dir, name, order):
    counts = prof.column_counts(prof.cells(fixtures.table(spark, sf_dir, name), order))
    return prof.suggest_roles(prof.detect_types(counts))


@query
def suggest_roles(spark, sf_dir):
    parts = [_roles(spark, sf_dir, "part", "p_partkey"), _roles(spark, sf_dir, "events", "event_id")]
    return parts[0].unionByName(parts[1]).select("column_name", "detected_type", "suggested_role", "role_confidence")


@query
def suggest_schema(spark, sf_dir):
    found = prof.suggest_schema(_roles(spark, sf_dir, "events", "event_id"))
    return found.select(
        "date_column",
        *[F.array_join(c, ",").alias(c) for c in ("identifiers", "metrics", "warnings")],
    )
