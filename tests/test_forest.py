import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenceline.operators import forest
from fenceline.operators.features import daily_features, feature_baseline
from fenceline.settings import DetectionSettings

INPUTS = ("a", "b", "c")


def points(spark, n=600, seed=0, scope="global"):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    x[0] = (9, -9, 9)
    pdf = pd.DataFrame(x, columns=list(INPUTS)).assign(scope=scope, row_key=[f"{scope}-{i}" for i in range(n)])
    return spark.createDataFrame(pdf)


def scores(rows, **kw):
    trees = forest.fit_forest(rows, INPUTS, 2)
    return {r["row_key"]: r["score"] for r in forest.score_rows(rows, trees, INPUTS, 2, **kw).collect()}


def test_share_and_extreme(spark):
    rows = points(spark)
    out = {r["row_key"]: r for r in forest.single_scope_scores(rows.drop("scope"), INPUTS, 600).collect()}
    assert len(out) == 600
    assert sum(r["is_anomaly"] for r in out.values()) == 30  # contamination 0.05
    assert out["global-0"]["anomaly_score"] == min(r["anomaly_score"] for r in out.values()) < 0


def test_partitioning_groups_and_scaling_do_not_matter(spark):
    rows = points(spark)
    base = scores(rows)
    assert scores(rows.repartition(11), rows_per_group=37) == base
    scaled = scores(rows.withColumn("a", F.col("a") * 1024).withColumn("b", F.col("b") / 64))
    assert scaled == pytest.approx(base)


def test_trees_have_the_sample_size_and_depth(spark):
    trees = forest.fit_forest(points(spark), INPUTS, 1).toPandas()
    assert len(trees) == 100 and set(trees["sample_size"]) == {256}
    assert all(max(p) < 8 + forest.average_path(256) for p in trees["path"])
    small = forest.fit_forest(points(spark, 40), INPUTS, 1).toPandas()
    assert set(small["sample_size"]) == {40}


def test_large_scope_next_to_small_ones(spark):
    """One scope holds most rows: its rows draw for one tree each, and its groups are split."""
    rows = points(spark, 60_000, 1, "hot").unionByName(points(spark, 150, 2, "cold"))
    trees = forest.fit_forest(rows, INPUTS, 2)
    sizes = {(r["scope"], r["tree"]): r["sample_size"] for r in trees.select("scope", "tree", "sample_size").collect()}
    assert len(sizes) == 200 and {v for (s, _), v in sizes.items() if s == "hot"} == {256}
    assert {v for (s, _), v in sizes.items() if s == "cold"} == {150}
    scored = forest.score_rows(rows, trees, INPUTS, 2, rows_per_group=5_000)
    by = {r["scope"]: r for r in scored.groupBy("scope").agg(F.count("*").alias("n"), F.min("score").alias("low")).collect()}
    assert (by["hot"]["n"], by["cold"]["n"]) == (60_000, 150)
    extreme = scored.filter("row_key = 'hot-0'").first()["score"]
    assert extreme == by["hot"]["low"]


def test_without_broadcast(spark, monkeypatch):
    rows = points(spark, 900, 1, "x").unionByName(points(spark, 150, 2, "y"))
    base = scores(rows)
    monkeypatch.setattr(forest, "BROADCAST_SCOPES", 0)
    assert scores(rows) == base


def test_offsets_are_the_exact_percentile(spark):
    rng = np.random.default_rng(1)
    values = {s: -rng.random(n) for s, n in (("x", 1000), ("y", 123))}
    df = spark.createDataFrame([(s, float(v)) for s, vs in values.items() for v in vs], "scope string, score double")
    for most in (1_000_000, 20):
        got = {r["scope"]: r["offset"] for r in forest.offsets(df, 0.05, most).collect()}
        assert got == {s: float(np.percentile(vs, 5)) for s, vs in values.items()}


DAILY = (
    "date date, store_id string, sku_id string, on_hand int, sold int, delivered int, returned int, "
    "price double, promo_flag boolean"
)


def daily(spark):
    """A busy store, and one with a row a week that depends on the global model."""
    rng = np.random.default_rng(4)
    rows = []
    for day in range(120):
        date = dt.date(2024, 1, 1) + dt.timedelta(day)
        for sku in range(5):
            price = None if (sku, day) == (4, 0) else 9.0 + float(rng.random())
            row = (100 + int(rng.integers(0, 9)), int(rng.integers(10, 30)), int(rng.integers(0, 5)), int(rng.integers(0, 3)), price)
            if (day, sku) == (100, 2):
                row = (-100, 5000, 300, 50, 500.0)
            rows.append((date, "busy", f"k{sku}", *row, bool(day % 7 == 0)))
        if day % 7 == 0:
            rows.append((date, "quiet", "k0", 50, int(rng.integers(1, 4)), 0, 0, 2.0, False))
    return spark.createDataFrame(rows, DAILY)


def test_daily_scopes_scores_and_reasons(spark):
    baseline = feature_baseline(daily_features(daily(spark))).cache()
    cuts = {r["scope"]: r["cutoff"] for r in forest.cutoffs(baseline).collect()}
    assert set(cuts) == {"store:busy", "global"}
    out = forest.forest_results(baseline).collect()
    assert len(out) == baseline.count()
    first = baseline.agg(F.min("day_number")).first()[0]
    for r in out:
        day = (r["date"] - dt.date(1970, 1, 1)).days
        if r["store_id"] == "busy" and day >= cuts["store:busy"]:
            assert r["fallback_used"] is None
        elif day >= cuts["global"]:
            assert r["fallback_used"] == "global"
        else:
            assert r["fallback_used"] == "insufficient_data" and not r["is_anomaly"] and r["anomaly_score"] == 0
            assert r["reasons"] == []
    assert {r["fallback_used"] for r in out} == {None, "global", "insufficient_data"}
    spike = next(r for r in out if r["date"] == dt.date(2024, 1, 1) + dt.timedelta(100) and r["sku_id"] == "k2" and r["store_id"] == "busy")
    assert spike["is_anomaly"], spike
    assert [x["feature"] for x in spike["reasons"]] == ["price", "sold", "delivered"]
    assert spike["reasons"][1]["message"].endswith("std above average") and spike["reasons"][1]["value"] == 5000.0
    assert cuts["global"] <= cuts["store:busy"] and first < cuts["global"]
    baseline.unpersist()


def test_vector_fills_missing_with_zero(spark):
    row = forest.forest_features(daily_features(daily(spark))).filter("store_id = 'busy' and sku_id = 'k4'").orderBy("date").first()
    assert row["price"] == 0.0 and row["delta_on_hand"] == 0.0 and row["promo_flag"] == 1.0 and row["day_of_week"] == 0.0


def test_settings_reach_the_model(spark):
    settings = DetectionSettings(forest_trees=7, forest_sample=32)
    trees = forest.fit_forest(points(spark), INPUTS, 1, settings).toPandas()
    assert len(trees) == 7 and set(trees["sample_size"]) == {32}
