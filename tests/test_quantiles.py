import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.functions.quantiles import (
    array_quantile,
    exact_quantiles,
    histogram_quantiles,
    running_quantiles,
    splitter_quantiles,
)
from fenceline.operators.tukey import with_fences

PROBS, NAMES = (0.25, 0.5, 0.75), ("a", "b", "c")


def fences(spark, values, k=1.5):
    df = spark.createDataFrame([(list(map(float, values)),)], "v array<double>")
    q = df.select(
        F.explode("v").alias("actual_value"),
        array_quantile(F.sort_array("v"), 0.25).alias("q1"),
        array_quantile(F.sort_array("v"), 0.75).alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    return with_fences(q, k).collect()


def flagged(rows):
    return [r["actual_value"] for r in rows if r["is_outlier"]]


# The fences of 1 to 10.
def test_known_fences(spark):
    r = fences(spark, range(1, 11))[0]
    assert (r["q1"], r["q3"], r["iqr"], r["lower_fence"], r["upper_fence"]) == (3.25, 7.75, 4.5, -3.5, 14.5)


@pytest.mark.parametrize(
    "values",
    [
        [*range(31, 52, 3), 400],
        [-7 * k for k in range(6)] + [-900, -901],
        [2.5] * 7,
        [3**k for k in range(9)],
    ],
)
def test_flags(spark, values):
    low, high = np.quantile(values, [0.25, 0.75])
    outside = [float(v) for v in values if v < low - 1.5 * (high - low) or v > high + 1.5 * (high - low)]
    assert flagged(fences(spark, values)) == outside


def test_negative_values(spark):
    values = [-41, -2, -13, -30, -8, -25, -19]
    r = fences(spark, values)[0]
    low, high = np.quantile(values, [0.25, 0.75])
    assert (r["q1"], r["q3"]) == (low, high)
    assert (r["lower_fence"], r["upper_fence"]) == (low - 1.5 * (high - low), high + 1.5 * (high - low))


def test_fences_widen_with_factor(spark):
    narrow, wide = fences(spark, range(1, 21))[0], fences(spark, range(1, 21), 3.0)[0]
    assert wide["lower_fence"] < narrow["lower_fence"] and wide["upper_fence"] > narrow["upper_fence"]


def skewed_table(spark):
    """Two metrics; a third of the rows of one carry the same value, and there are wild extremes."""
    rng = np.random.default_rng(3)
    values = {"m": np.concatenate([rng.lognormal(3, 2, 4000), np.full(2000, 17.25), [1e12, -1e12]]), "n": rng.normal(0, 1, 501)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("m", None), ("n", float("nan"))]
    return values, spark.createDataFrame(rows, "metric string, v double").repartition(7)


@pytest.mark.parametrize("small_domain", [1_000_000, 50])
def test_exact_quantiles_match_numpy(spark, small_domain):
    values, df = skewed_table(spark)
    got = {r["metric"]: r for r in exact_quantiles(df, "metric", "v", PROBS, NAMES, small_domain).collect()}
    for k, vs in values.items():
        assert got[k]["n"] == len(vs)
        assert [got[k][c] for c in NAMES] == [float(np.percentile(vs, 100 * p)) for p in PROBS]


@pytest.mark.parametrize("block", [None, 16, 65_536])
def test_histogram_quantiles_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    values = {g: rng.integers(-(10**g), 10**g, 300) for g in range(1, 6)}
    df = spark.createDataFrame([(g, int(v)) for g, vs in values.items() for v in vs], "g int, v bigint")
    hist = df.groupBy("g", "v").agg(F.count("*").alias("w"))
    got = {r["g"]: r for r in histogram_quantiles(hist, ["g"], "v", "w", PROBS, NAMES, block).collect()}
    for g, vs in values.items():
        assert [got[g][c] for c in NAMES] == [float(np.percentile(vs, 100 * p)) for p in PROBS]


def test_splitters_bound_every_window(spark, tmp_path, monkeypatch):
    """Groups of very different size, heavy values and ties at the ranks; brackets shrink to 400 values at most."""
    from fenceline.functions import quantiles

    rng = np.random.default_rng(8)
    values = {
        "one": np.array([4]),
        "same": np.full(500, -3),
        "small": rng.integers(0, 20, 25),
        "wide": rng.integers(-(2**40), 2**40, 6000),
        "heavy": np.concatenate([rng.integers(0, 3000, 3000), np.full(4000, 77), np.full(3000, 2999)]),
    }
    df = spark.createDataFrame([(g, int(v)) for g, vs in values.items() for v in vs], "g string, v bigint")
    df.groupBy("g", "v").agg(F.count("*").alias("w")).write.parquet(str(tmp_path / "hist"))
    sizes, keep = [], quantiles.materialize

    def watched(table, label):
        out = keep(table, label)
        sizes.append(out.agg(F.max("__d")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "materialize", watched)
    hist = spark.read.parquet(str(tmp_path / "hist"))
    probs = (0.0, 0.05, 0.25, 0.5, 0.99, 1.0)
    got = {r["g"]: r for r in splitter_quantiles(hist, ["g"], "v", "w", probs, "abcdef", most=400, sample=150).collect()}
    assert len(sizes) > 2 and sizes[-1] <= 400
    for g, vs in values.items():
        assert got[g]["n"] == len(vs)
        assert [got[g][c] for c in "abcdef"] == pytest.approx([float(np.percentile(vs, 100 * p)) for p in probs], rel=1e-12)


@pytest.mark.parametrize("fan_out", [64, 1 << 17])
def test_running_quantiles_follow_the_window(spark, fan_out):
    rng = random.Random(fan_out)
    rows = [
        (key, rng.choice([0, -7, rng.randint(-40_000, 40_000), rng.randint(0, 9)]), start, start + rng.randint(1, 6))
        for key, n in [("hot", 400), ("few", 9), ("one", 1), ("far", 3)]
        for start in (rng.randint(0, 20) for _ in range(n))
    ]
    rows += [("far", 3_000_000_000, 2, 5), ("far", -3_000_000_000, 2, 6)]
    changes = [(k, v, a, 1) for k, v, a, _ in rows] + [(k, v, b, -1) for k, v, _, b in rows]
    current = {(k, at): [v for k2, v, a, b in rows if k2 == k and a <= at < b] for k in ("hot", "few", "one", "far") for at in range(0, 28, 2)}
    changes = spark.createDataFrame(changes, "g string, v bigint, at int, change bigint")
    wanted = spark.createDataFrame([(k, at, len(vs)) for (k, at), vs in current.items()], "g string, at int, n bigint")
    got = {
        (r["g"], r["at"]): [r[name] for name in NAMES]
        for r in running_quantiles(changes, wanted, ["g"], "v", PROBS, NAMES, fan_out).collect()
    }
    assert set(got) == {place for place, vs in current.items() if vs}
    for place, found in got.items():
        assert np.allclose(found, np.quantile(current[place], PROBS), rtol=1e-12), place


def test_running_quantiles_of_nothing(spark):
    changes = spark.createDataFrame([], "g string, v bigint, at int, change bigint")
    wanted = spark.createDataFrame([("a", 1, 0)], "g string, at int, n bigint")
    assert running_quantiles(changes, wanted, ["g"], "v", PROBS, NAMES).collect() == []
