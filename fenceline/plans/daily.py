"""Fixed-schema pipeline: daily rows to features, detections and incidents."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenceline.functions.summary import side_by_side
from fenceline.operators import incidents as inc
from fenceline.operators.detections import forest_detections, tukey_detections
from fenceline.operators.features import daily_features, feature_baseline
from fenceline.operators.forest import forest_results
from fenceline.operators.reports import detection_mode
from fenceline.operators.tukey import tukey_results
from fenceline.settings import DEFAULTS, DetectionSettings
from fenceline.sources.shared import materialize
from fenceline.sources.versioned import VersionedTables


class DuplicateRows(ValueError):
    pass


@dataclass(frozen=True)
class DailyRun:
    """Everything one run produces; each table is written once and lazily read from there."""

    mode: str
    features: DataFrame
    detections: DataFrame
    incidents: DataFrame
    items: DataFrame
    notes: DataFrame
    stats: DataFrame


def run_detection(
    raw: DataFrame,
    as_of: Column,
    existing: DataFrame | None = None,
    settings: DetectionSettings = DEFAULTS,
    with_forest: bool = True,
) -> DailyRun:
    """One full run over all dates of ``raw``.

    The driver decides only from one-row summaries: the mode, and the size checks inside the
    operators. Features, detections and flagged rows are written to the shared folder, since several
    outputs read them.
    """
    features = materialize(daily_features(raw, settings), "features")
    if with_forest:  # reads the features twice, so they are stored first
        features = materialize(feature_baseline(features, settings), "feature-baselines")

    # The features already sit next to their predecessor, so this needs no shuffle of its own.
    repeated = features.filter("prev_day_number = day_number").select("date", "store_id", "sku_id").take(3)
    if repeated:
        raise DuplicateRows(f"(date, store, SKU) must be unique, but e.g. {repeated}")
    mode = detection_mode(features).first()
    metrics = [m for m in mode["metrics"].split(",") if m]

    parts = []
    if metrics:
        parts.append(tukey_detections(tukey_results(features, metrics, settings)))
    if with_forest:
        parts.append(forest_detections(forest_results(features, settings)))
    if not parts:
        raise ValueError("Neither stock nor sales are present in enough rows to detect anything")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    detections = materialize(both, "detections")

    return _roll_up(features, detections, existing, as_of, mode["mode"])


def _roll_up(
    features: DataFrame, detections: DataFrame, existing: DataFrame | None, as_of: Column, mode: str
) -> DailyRun:
    flagged = materialize(inc.flagged_rows(detections, features), "flagged")
    run = materialize(inc.run_incidents(inc.incident_groups(flagged)), "run")
    if existing is None:
        created, incidents = run, inc.new_incidents(run, as_of)
    else:
        created = run.join(existing.select("dedup_key"), "dedup_key", "left_anti")
        incidents = inc.merge_incidents(existing, run, as_of).drop("change")
    return DailyRun(
        mode,
        features,
        detections,
        incidents,
        inc.incident_items(created, flagged, detections),
        inc.creation_notes(created, as_of),
        run_stats(features, detections, run, existing, mode),
    )


def run_stats(
    features: DataFrame, detections: DataFrame, run: DataFrame, existing: DataFrame | None, mode: str
) -> DataFrame:
    """One row of counts; fence flags are counted per metric."""
    detector = F.col("detector_type")
    made = features.agg(F.count(F.lit(1)).alias("features_created"))
    flags = detections.agg(
        F.count_if((detector == "tukey") & F.col("is_outlier")).alias("tukey_flags"),
        F.count_if((detector == "isolation_forest") & F.col("is_outlier")).alias("isolation_forest_flags"),
    )
    counts = inc.run_counts(run, existing)
    return side_by_side(made, flags, counts).withColumn("detection_mode", F.lit(mode))


# --- runs over a span of dates, into versioned tables ---------------------------------------------

#: Reports ask for stores and SKUs.
CLUSTER = ("store_id", "sku_id")
PAIR = ["store_id", "sku_id"]
DAY = dt.timedelta(days=1)


def store_run(tables: VersionedTables, run: DailyRun, first: dt.date, last: dt.date) -> int:
    """Make a run the current state: features and detections of its dates replace what was there, the incident table is
    its next snapshot, items and notes of created incidents are added. Returns the version."""
    change = tables.begin()
    change.replace_range("features", run.features, first, last, CLUSTER)
    change.replace_range("detections", run.detections, first, last, CLUSTER)
    change.snapshot("incidents", run.incidents)
    change.append("items", run.items)
    change.append("notes", run.notes)
    # The last row of every pair is what the next dates continue from.
    new = run.features.where(F.col("date").between(F.lit(first), F.lit(last)))
    if not tables.has("tail"):
        change.snapshot("tail", last_rows(new))
    elif _ends_before(tables, first):
        change.snapshot("tail", last_rows(new.unionByName(tables.read("tail"), allowMissingColumns=True)))
    else:  # an older span ran again: pairs may have lost their last row
        before, after = tables.read("features", last=first - DAY), tables.read("features", first=last + DAY)
        kept = before.unionByName(after, allowMissingColumns=True)
        change.snapshot("tail", last_rows(new.unionByName(kept, allowMissingColumns=True)))
    return change.commit()


def _ends_before(tables: VersionedTables, first: dt.date) -> bool:
    """Whether no stored row lies on or after a day."""
    latest = tables.read("tail").agg(F.max("date")).first()[0]
    return latest is None or latest < first


def last_rows(features: DataFrame) -> DataFrame:
    """The latest row of every pair."""
    row = F.max_by(F.struct(*features.columns), "date").alias("row")
    return features.groupBy(*PAIR).agg(row).select("row.*")


def run_range(
    tables: VersionedTables,
    raw: DataFrame,
    as_of: Column,
    first: dt.date,
    last: dt.date,
    settings: DetectionSettings = DEFAULTS,
) -> DailyRun:
    """Fences and incidents of the dates ``first`` to ``last`` from their rows alone and what is stored before them.

    Read of the stored history are the days of one window and each pair's last row, not the rest. The result is what a
    run over the whole history gives for these dates. ``store_run`` makes it current.
    """
    new = raw.where(F.col("date").between(F.lit(first), F.lit(last)))
    begin, end = first - settings.window_days * DAY, first - DAY
    columns = raw.columns
    history = None
    if tables.has("features"):
        history = materialize(tables.read("features", first=begin, last=end), "history")
        earlier = _last_before(tables, begin, first)
        seen = new.unionByName(history.select(*columns)).unionByName(earlier.select(*columns))
    else:
        seen = new
    inside = F.col("date").between(F.lit(first), F.lit(last))
    features = materialize(daily_features(seen, settings).where(inside), "features")
    repeated = features.filter("prev_day_number = day_number").select("date", "store_id", "sku_id").take(3)
    if repeated:
        raise DuplicateRows(f"(date, store, SKU) must be unique, but e.g. {repeated}")
    both = features if history is None else features.unionByName(history.select(*features.columns))
    mode = detection_mode(both).first()
    metrics = [m for m in mode["metrics"].split(",") if m]
    if not metrics:
        raise ValueError("Neither stock nor sales are present in enough rows to detect anything")
    # Rows of the window are baselines only.
    detections = materialize(tukey_detections(tukey_results(both, metrics, settings)).where(inside), "detections")
    existing = tables.read("incidents") if tables.has("incidents") else None
    return _roll_up(features, detections, existing, as_of, mode["mode"])


def _last_before(tables: VersionedTables, begin: dt.date, first: dt.date) -> DataFrame:
    """Every pair's last stored row before ``begin``: of the stored last rows, or of the features where an older span
    runs again. Pairs with rows from ``begin`` to ``first`` may be left out, as these are read anyway."""
    if _ends_before(tables, first):
        return tables.read("tail").where(F.col("date") < F.lit(begin))
    return last_rows(tables.read("features", last=begin - DAY))
