"""Order statistics by narrowing against sorting, for groups and values of any kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import staged
from tremorlake.operators import detectors, selection, statistics


def table(spark, groups):
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, values in groups.items() for v in values], "k string, v double")


HOSTILE = {
    "one": [3.0],
    "pair": [1.0, 2.0],
    "ties": [5.0] * 999 + [7.0],
    "signs": [*(-(10.0**e) for e in range(-300, 300, 7)), 0.0, *(10.0**e for e in range(-300, 300, 5))],
    "near": [1.0 + i * 2.0**-52 for i in range(4000)],
    "negative": [-math.exp(i / 3) for i in range(501)],
    "gaps": [None, float("nan"), 2.0, 4.0, None],
    "extremes": [-1.7e308, 1.7e308, 1.0, 5e-324],
}


@pytest.mark.parametrize("few", [selection.FEW, 1])
def test_medians_of_hostile_values(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    got = {r["k"]: (r["median"], r["n"]) for r in selection.medians(table(spark, HOSTILE), ["k"], "v").collect()}
    for k, values in HOSTILE.items():
        real = [v for v in values if v is not None and math.isfinite(v)]
        assert got[k] == (np.median(real), len(real)), k
    assert selection.medians(table(spark, {"x": [None]}), ["k"], "v").count() == 0
    assert selection.medians(table(spark, {"a": [1.0, 4.0], "b": [6.0]}), [], "v").first()["median"] == 4.0


def test_null_group_and_written_state(spark, monkeypatch):
    monkeypatch.setattr(staged, "FEW_ROWS", 1)
    groups = {None: list(range(100)), "a": list(range(50, 171))}
    got = {r["k"]: r["median"] for r in selection.medians(table(spark, groups), ["k"], "v").collect()}
    assert got == {None: 49.5, "a": 110.0}


@pytest.mark.parametrize("few", [selection.FEW, 0])
def test_weighted_ranks(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    rows = spark.createDataFrame([("a", 10.0, 3), ("a", 20.0, 5), ("a", 30.0, 1), ("a", 30.0, 1), ("b", 1.0, 4), ("b", 0.0, 0)], "k string, v double, w int")
    ranks = spark.createDataFrame([("a", 1), ("a", 3), ("a", 4), ("a", 9), ("a", 11), ("a", 0), ("b", 4), ("c", 1)], "k string, rank int")
    got = {(r["k"], r["rank"]): (r["value"], r["before"], r["own"], r["after"]) for r in selection.select(rows, ["k"], "v", ranks, "w").collect()}
    assert got == {("a", 1): (10, 0, 3, 20), ("a", 3): (10, 0, 3, 20), ("a", 4): (20, 3, 5, 30), ("a", 9): (30, 8, 2, None), ("b", 4): (1, 0, 4, None)}


def test_hot_group_is_counted_by_ranges(spark):
    """A third of all rows in one group: no percentile in the plan, and a task hands on no more than its ranges."""
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), (F.hash("id") / 1000).alias("v"))
    out = selection.medians(rows, ["k"], "v")
    plan = statistics.robust_scales(rows, ["k"], "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan
    want = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r["k"]: r["median"] for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-14) for k in want)


def test_robust_scales_and_deviation_without_percentiles(spark):
    x = np.random.default_rng(2).normal(size=(301, 3))
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").withColumn("d", F.lit(None).cast("double"))
    d = detectors.MaxDeviation.fit(rows, ["a", "b", "c"])
    assert np.allclose(d.centre, np.median(x, axis=0)) and np.allclose(d.scale, 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0))
    assert detectors.MaxDeviation.fit(rows, ["a", "d"]).score(rows).where("score is not null").count() == 301
