"""Nearest neighbours by the pivot index against whole distance tables."""

import numpy as np
from pyspark.sql import functions as F

from tremorlake.operators import detectors, neighbours


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "qid bigint, v array<double>")


def queries(spark, x):
    return vectors(spark, x).select("qid", "v", F.lit(None).cast("array<double>").alias("ratio"), F.lit(None).alias("skip"))


def clusters(rng, n, d=4):
    return rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 8 + rng.normal(size=(n, d)) * 0.3


def brute(q, r, k, w=None, skip=None):
    d = np.sqrt((((q[:, None] - r[None]) * (1 if w is None else w[:, None])) ** 2).sum(2))
    if skip is not None:
        d[np.arange(len(q)), skip] = np.inf
    return np.sort(d, axis=1)[:, :k]


def test_exact_over_many_rings_and_a_hot_ring(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RING_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 64)
    rng = np.random.default_rng(1)
    r = np.vstack([clusters(rng, 1500), np.repeat(clusters(rng, 1), 700, axis=0)])  # a third of all rows are one vector
    q = np.vstack([clusters(rng, 150), r[:20], r[-100:], rng.normal(size=(10, 4)) * 40])
    index = neighbours.PivotIndex.build(vectors(spark, r))
    assert index.rings.agg(F.max("n")).first()[0] <= 50
    got = {x["qid"]: x for x in index.nearest(queries(spark, q), 10).collect()}
    want = brute(q, r, 10)
    assert len(got) == len(q)
    for i in range(len(q)):
        assert np.isclose(got[i]["mean"], want[i].mean(), rtol=1e-9, atol=1e-9) and np.isclose(got[i]["farthest"], want[i, -1], atol=1e-9) and got[i]["n"] == 10


def test_own_units_and_left_out_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RING_ROWS", 40)
    rng = np.random.default_rng(2)
    r = clusters(rng, 400)
    w = rng.uniform(0.7, 1.4, size=r.shape)
    asked = spark.createDataFrame([(i, a.tolist(), b.tolist(), str(i)) for i, (a, b) in enumerate(zip(r, w))], "qid bigint, v array<double>, ratio array<double>, skip string")
    got = {x["qid"]: x["mean"] for x in neighbours.PivotIndex.build(vectors(spark, r), "qid").nearest(asked, 5).collect()}
    want = brute(r, r, 5, w, np.arange(400)).mean(1)
    assert np.allclose([got[i] for i in range(400)], want)


def test_few_rows_and_no_rows(spark):
    x = np.arange(6.0).reshape(3, 2)
    index = neighbours.PivotIndex.build(vectors(spark, x))
    got = index.nearest(queries(spark, x), 10).orderBy("qid").collect()
    assert [r["n"] for r in got] == [3, 3, 3] and np.allclose([r["mean"] for r in got], brute(x, x, 3).mean(1))
    assert neighbours.PivotIndex.build(vectors(spark, x).limit(0)) is None
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 2.0, 1.0), (4, 5.0, 5.0)], "rid int, x0 double, x1 double")
    scored = {r["rid"]: r["score"] for r in detectors.NearestNeighbours.fit(rows, ["x0", "x1"]).score(rows).collect()}
    assert scored.keys() == {1, 2, 3, 4} and scored[2] is None and scored[1] is not None
    flat = rows.withColumn("x1", F.lit(1.0))
    assert detectors.NearestNeighbours.fit(flat, ["x0", "x1"]).score(flat).where("score is not null").count() == 0


def test_most_distances_are_skipped_and_more_so_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "RING_ROWS", 32)
    rng = np.random.default_rng(3)
    shares = []
    for n in (1000, 4000):
        index = neighbours.PivotIndex.build(vectors(spark, clusters(rng, n)))
        done, all_ = index.compared(vectors(spark, clusters(rng, 100)), 10)
        shares.append(1 - done / all_)
    assert shares[0] > 0.5 and shares[1] > shares[0]
