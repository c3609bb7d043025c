import datetime as dt
import random

import numpy as np
import pytest

from fenceline.operators import tukey
from fenceline.operators.features import daily_features
from fenceline.settings import DetectionSettings

RAW = (
    "date date, store_id string, sku_id string, on_hand int, sold int, delivered int, returned int, "
    "price double, promo_flag boolean"
)


def daily_rows(seed=1, spread=60):
    """Dense and sparse pairs with gaps; one store holds most rows."""
    rng = random.Random(seed)
    rows = []
    for store, sku, chance in [("A", "x", 0.9), ("A", "y", 0.3), ("A", "z", 0.1), ("B", "x", 0.1), ("C", "q", 0.05), ("A", "w", 0.85)]:
        for day in range(90):
            if rng.random() < chance:
                sold = rng.randint(0, spread) if rng.random() > 0.05 else rng.randint(200, 300)
                rows.append((dt.date(2024, 1, 1) + dt.timedelta(day), store, sku, rng.randint(0, 500), sold, 1, 0, 2.5, False))
    return rows


def brute_force(rows, window=28, least=10, k=1.5):
    """Row by row, straight from the definition."""
    by_pair = {}
    for r in sorted(rows):
        by_pair.setdefault((r[1], r[2]), []).append((r[0], r[3], r[4]))
    out = {}
    day = dt.timedelta(1)

    def baseline(metric, t, store, sku):
        values = []
        for (s, q), hist in by_pair.items():
            if store not in (None, s) or sku not in (None, q):
                continue
            inside = [h for h in hist if t - (window + (metric != "sold")) * day <= h[0] < t]
            if metric == "sold":
                values += [h[2] for h in inside]
            else:
                values += [b[1] - a[1] for a, b in zip(inside, inside[1:]) if b[0] >= t - window * day]
        return values

    for (store, sku), hist in by_pair.items():
        for i, (t, on_hand, sold) in enumerate(hist):
            targets = {"sold": sold}
            if i and hist[i - 1][0] == t - day:
                targets["delta_on_hand"] = on_hand - hist[i - 1][1]
            for metric, value in targets.items():
                for label, s, q in [(None, store, sku), ("store", store, None), ("sku", None, sku), ("global", None, None)]:
                    values = baseline(metric, t, s, q)
                    if len(values) >= least:
                        break
                else:
                    out[t, store, sku, metric] = (value, "insufficient_data", len(values), 0, 0, False)
                    continue
                q1, q3 = np.percentile(values, 25), np.percentile(values, 75)
                low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
                out[t, store, sku, metric] = (value, label, len(values), q1, q3, value < low or value > high)
    return out


def as_dict(results):
    return {
        (r["date"], r["store_id"], r["sku_id"], r["metric_name"]): (
            r["actual_value"], r["fallback_used"], r["sample_size"], r["q1"], r["q3"], r["is_outlier"],
        )
        for r in results.collect()
    }


@pytest.mark.parametrize("block", [65_536, 8])
def test_fallback_matches_definition(spark, monkeypatch, block):
    monkeypatch.setattr(tukey, "BLOCK", block)
    rows = daily_rows()
    features = daily_features(spark.createDataFrame(rows, RAW))
    got = as_dict(tukey.tukey_results(features))
    want = brute_force(rows)
    assert {v[1] for v in want.values()} == {None, "store", "sku", "global", "insufficient_data"}
    assert got == want


@pytest.mark.parametrize("most", [32_768, 25, 0])
def test_only_large_windows_open_blocks(spark, monkeypatch, most):
    """Windows that see few observations are ordered; the others are counted, with the same results."""
    counted, keep = [], tukey.running_quantiles

    def watched(changes, wanted, *rest):
        counted.extend(r["n"] for r in wanted.collect())
        return keep(changes, wanted, *rest)

    monkeypatch.setattr(tukey, "running_quantiles", watched)
    monkeypatch.setattr(tukey, "MOST", most)
    rows = daily_rows(5)
    # Many rows of one store on one day, in the middle of small windows.
    rows += [(dt.date(2024, 2, 10), "C", f"s{i:02d}", i, 7 * i % 31, 1, 0, 2.5, False) for i in range(40)]
    assert as_dict(tukey.tukey_results(daily_features(spark.createDataFrame(rows, RAW)))) == brute_force(rows)
    assert bool(counted) == (most < 32_768)
    assert not counted or min(counted) >= (10 if most == 0 else 20)


def test_values_over_a_wide_range(spark):
    rows = [(*r[:3], r[3] * 3_000_000, r[4] * 7_000_000, *r[5:]) for r in daily_rows(4)]
    features = daily_features(spark.createDataFrame(rows, RAW))
    assert as_dict(tukey.tukey_results(features)) == brute_force(rows)


def test_partitioning_and_order_do_not_matter(spark):
    rows = daily_rows(2)
    once = as_dict(tukey.tukey_results(daily_features(spark.createDataFrame(rows, RAW))))
    random.Random(0).shuffle(rows)
    again = as_dict(tukey.tukey_results(daily_features(spark.createDataFrame(rows, RAW).repartition(13))))
    assert once == again


def test_single_metric_and_other_settings(spark):
    rows = daily_rows(3)
    settings = DetectionSettings(window_days=14, min_samples=5, fence_factor=3.0)
    features = daily_features(spark.createDataFrame(rows, RAW), settings)
    got = as_dict(tukey.tukey_results(features, ["sold"], settings))
    want = {k: v for k, v in brute_force(rows, 14, 5, 3.0).items() if k[3] == "sold"}
    assert got == want


def test_reason_text(spark):
    df = spark.createDataFrame(
        [("sold", 100.0, 82.125, 17.875, -3.5, True), ("sold", -9.25, -5.75, 14.5, -3.5, True), ("sold", 1.0, 0.0, 2.0, 0.0, False)],
        "metric_name string, actual_value double, outlier_distance double, upper_fence double, lower_fence double, is_outlier boolean",
    )
    reasons = [r["reason"] for r in tukey.tukey_reasons(df).collect()]
    assert reasons[0]["type"] == "above_upper_fence"
    assert reasons[0]["message"] == "sold value (100.0) is 82.1 above upper fence (17.9)"
    assert reasons[1]["message"] == "sold value (-9.2) is 5.8 below lower fence (-3.5)"
    assert reasons[2] is None
