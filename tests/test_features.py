import datetime as dt

import numpy as np
import pytest
from test_tukey import RAW, daily_rows

from fenceline.operators.features import daily_features, feature_baseline


def test_daily_features(spark):
    rows = daily_rows(7)
    got = {(r["date"], r["store_id"], r["sku_id"]): r for r in daily_features(spark.createDataFrame(rows, RAW)).collect()}
    assert len(got) == len(rows)
    by_pair = {}
    for r in sorted(rows):
        hist = by_pair.setdefault(r[1:3], [])
        g = got[r[0], r[1], r[2]]
        assert g["delta_on_hand"] == (r[3] - hist[-1][3] if hist else None)
        assert g["day_of_week"] == r[0].weekday()
        recent = [h for h in hist if r[0] - dt.timedelta(28) <= h[0]]
        if recent:
            assert g["sold_rolling_mean"] == pytest.approx(np.mean([h[4] for h in recent]))
            assert g["on_hand_rolling_std"] == pytest.approx(np.std([h[3] for h in recent]), abs=1e-9)
        else:
            assert g["sold_rolling_mean"] is None and g["on_hand_rolling_std"] is None
        hist.append(r)


def test_baseline_falls_back_to_the_store(spark):
    rows = daily_rows(8)
    features = daily_features(spark.createDataFrame(rows, RAW)).cache()
    all_rows = [r.asDict() for r in features.collect()]
    levels = set()
    for g in feature_baseline(features).collect():
        start = g["date"] - dt.timedelta(28)
        store = [r for r in all_rows if r["store_id"] == g["store_id"] and start <= r["date"] < g["date"]]
        pair = [r for r in store if r["sku_id"] == g["sku_id"]]
        used = pair if len(pair) >= 5 else store
        levels.add("pair" if used is pair else "store" if store else "none")
        assert g["baseline_rows"] == len(used)
        for name in ("sold", "delta_on_hand", "price"):
            values = [r[name] for r in used if r[name] is not None]
            if not used:
                assert g[f"{name}_mean"] is None
                continue
            assert g[f"{name}_mean"] == pytest.approx(np.mean(values) if values else 0)
            assert g[f"{name}_std"] == pytest.approx(np.std(values) if len(values) > 1 else 1.0, abs=1e-9)
    assert levels == {"pair", "store", "none"}
    features.unpersist()
