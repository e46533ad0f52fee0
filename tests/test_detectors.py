"""Detectors, calibration and the protocol on synthetic records with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import dense
from tremorlake.operators import calibration, detectors, segments, statistics
from tremorlake.plans import protocol, reports, states


def frame(spark, x, names=None, **other):
    names = names or [f"x{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names)
    for k, v in other.items():
        pdf[k] = v
    pdf["rid"] = range(len(pdf))
    return spark.createDataFrame(pdf)


def scores(df):
    return df.orderBy("rid").toPandas()["score"].to_numpy()


def shrunk(x):
    z = x - x.mean(0)
    return dense.shrunk_covariance(len(x), z.T @ z / len(x), ((z**2).sum(1) ** 2).sum())


def distances(train, x):
    z = x - train.mean(0)
    return np.sqrt(np.einsum("ij,jk,ik->i", z, np.linalg.inv(shrunk(train)), z))


def test_shrinkage_is_definite_and_nearly_exact():
    small = np.random.default_rng(1).normal(size=(4, 6))
    assert np.linalg.eigvalsh(shrunk(small)).min() > 0
    true = np.array([[1, 0.8], [0.8, 1]])
    large = np.random.default_rng(2).multivariate_normal([0, 0], true, 20000)
    assert np.abs(shrunk(large) - true).max() < 0.05


def test_mahalanobis_and_its_folds(spark):
    x = np.random.default_rng(3).normal(size=(120, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2.0]])
    rows = frame(spark, x, day=np.arange(120) // 10)
    names = ["x0", "x1", "x2"]
    assert np.allclose(scores(detectors.Mahalanobis.fit(rows, names).score(rows)), distances(x, x))
    left = scores(detectors.leave_groups_out(rows, "day", names))
    for day in range(12):
        inside = np.arange(120) // 10 == day
        assert np.allclose(left[inside], distances(x[~inside], x[inside]))
    out = detectors.leave_one_out(detectors.Mahalanobis, rows, "rid", names).orderBy("rid").toPandas()["score"].to_numpy()
    assert (out > distances(x, x)).all()


def test_left_out_groups_with_missing_values_agree_with_refitting(spark):
    """A row without a feature counts nowhere: neither in its own group's fold nor in the others'."""
    x = np.random.default_rng(30).normal(size=(40, 2))
    rows = [(i, "abcd"[i % 4] if i < 36 else None, float(a), float(b)) for i, (a, b) in enumerate(x)]
    gaps = [(100 + i, "abce"[i % 4], None if i % 2 else 5.0, 1.0 if i % 2 else None) for i in range(9)]
    table = spark.createDataFrame(rows + gaps, "rid int, g string, x0 double, x1 double")
    got = {r["rid"]: r["score"] for r in detectors.leave_groups_out(table, "g", ["x0", "x1"]).collect()}
    groups = np.array([r[1] or "" for r in rows])
    want = {}
    for g in set(groups):
        inside = groups == g
        want |= dict(zip(np.flatnonzero(inside).tolist(), distances(x[~inside], x[inside])))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def refitted(name, x):
    """Scores of rows by fits on all others, with whole arrays."""
    out = []
    for i in range(len(x)):
        m = np.delete(x, i, axis=0)
        if name == "MaxDeviation":
            centre = np.median(m, axis=0)
            out.append((np.abs(x[i] - centre) / (1.4826 * np.median(np.abs(m - centre), axis=0))).max())
            continue
        z, u = (x[i] - m.mean(0)) / m.std(0), (m - m.mean(0)) / m.std(0)
        if name == "PcaResidual":
            out.append(np.linalg.norm(dense.discarded_directions(u.T @ u / len(u), 0.9)[0] @ z))
        else:
            out.append(np.sort(np.sqrt(((u - z) ** 2).sum(1)))[:10].mean())
    return np.array(out)


@pytest.mark.parametrize("n", [2, 7, 40])
def test_folds_without_a_matrix_of_all_rows(spark, n, monkeypatch):
    from tremorlake.operators import neighbours

    monkeypatch.setattr(neighbours, "RING_ROWS", 16)
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2.0]]), 1)  # with ties
    rows = frame(spark, x).unionByName(spark.createDataFrame([(None, 1.0, 2.0, 900)], "x0 double, x1 double, x2 double, rid long"))
    for detector in (detectors.MaxDeviation, detectors.PcaResidual, detectors.NearestNeighbours):
        got = {r["rid"]: r["score"] for r in detectors.leave_one_out(detector, rows, "rid", ["x0", "x1", "x2"]).collect()}
        assert got.keys() == set(range(n))
        if n > 2:
            want = refitted(detector.__name__, x)
            assert np.allclose([got[i] if got[i] is not None else np.inf for i in range(n)], want), detector


def test_own_detector_is_refitted(spark, monkeypatch):
    class Own:
        @classmethod
        def fit(cls, rows, features):
            return detectors.Mahalanobis.fit(rows, features)

    x = np.random.default_rng(31).normal(size=(6, 2))
    got = {r["rid"]: r["score"] for r in detectors.leave_one_out(Own, frame(spark, x), "rid", ["x0", "x1"]).collect()}
    for i in range(6):
        assert math.isclose(got[i], distances(np.delete(x, i, 0), x[i : i + 1])[0])
    monkeypatch.setattr(detectors, "REFITS", 5)
    with pytest.raises(ValueError):
        detectors.leave_one_out(Own, frame(spark, x), "rid", ["x0", "x1"])


def test_pca_breaks_pattern(spark):
    rng = np.random.default_rng(4)
    factor = rng.normal(size=(400, 1))
    x = factor @ np.array([[1.0, 1.0, 1.0]]) + 0.05 * rng.normal(size=(400, 3))
    d = detectors.PcaResidual.fit(frame(spark, x), ["x0", "x1", "x2"])
    assert d.retained == 1
    along, across = scores(d.score(frame(spark, np.array([[2.0, 2, 2], [1.0, -1, 1]]))))
    assert along < 0.3 and across > 1.5


def test_knn_follows_a_curve(spark):
    t = np.random.default_rng(10).uniform(-1, 1, 600)
    train = np.column_stack([t, t**2])
    points = frame(spark, np.array([[0.9, 0.81], [0.0, 0.6]]))
    d = detectors.NearestNeighbours.fit(frame(spark, train), ["x0", "x1"])
    on, off = scores(d.score(points))
    assert off > 5 * on


def test_max_deviation_and_degenerate_feature(spark):
    x = np.random.default_rng(14).normal(size=(40, 30))
    d = detectors.MaxDeviation.fit(frame(spark, x), [f"x{i}" for i in range(30)])
    one, all_ = np.zeros((1, 30)), np.full((1, 30), 1.2)
    one[0, 3] = 6
    a, b = scores(d.score(frame(spark, np.vstack([one, all_]))))
    assert a > 4 > b
    flat = frame(spark, np.column_stack([np.ones(9), np.arange(9.0)]))
    assert detectors.PcaResidual.fit(flat, ["x0", "x1"]).score(flat).where("score is not null").count() == 0


def test_cointegration(spark):
    rng = np.random.default_rng(13)
    trend = np.cumsum(rng.normal(size=3001))
    x = np.column_stack([trend, 2 * trend]) + 0.1 * rng.normal(size=(3001, 2))
    start = dt.datetime(2020, 1, 1)
    rows = frame(spark, x, ts=[start + dt.timedelta(hours=i) for i in range(3001)])
    d = detectors.Cointegration.fit(rows, ["x0", "x1"])
    along, broken = scores(d.score(frame(spark, np.array([[100.0, 200.0], [100.0, 205.0]]))))
    assert along < 3 and broken > 10


def test_gaussian_process_follows_a_bend(spark):
    rng = np.random.default_rng(11)
    t = rng.uniform(-10, 20, 3000)
    truth = lambda v: 4 - 0.01 * v - 0.05 * np.minimum(v, 0)
    rows = frame(spark, np.column_stack([t, truth(t) + 2e-3 * rng.normal(size=3000)]), ["t", "f"])
    gp = detectors.GaussianProcessBaseline.fit(rows, "t", ["f"])
    at = np.array([-8.0, -2.0, 5.0, 15.0])
    got = gp.residuals(frame(spark, np.column_stack([at, truth(at)]), ["t", "f"])).orderBy("rid").toPandas()["f"].to_numpy()
    assert np.abs(got).max() < 2e-3


def test_gaussian_process_equals_a_dense_solution(spark):
    """The curve from bins against one solution over all bins' kernel matrix, for each row; no temperature, no residual."""
    rng = np.random.default_rng(12)
    t = np.round(rng.uniform(-5, 25, 700), 1)
    f = 3 + np.sin(t / 6) + 0.05 * rng.normal(size=700)
    rows = frame(spark, np.column_stack([t, f]), ["t", "f"]).unionByName(spark.createDataFrame([(None, 1.0, 5000)], "t double, f double, rid long"))
    gp = detectors.GaussianProcessBaseline.fit(rows.where("t is not null"), "t", ["f"])
    bins = np.floor(t / 0.5)
    x, y, n = (np.array([v[bins == b].mean() if v is not None else (bins == b).sum() for b in np.unique(bins)]) for v in (t, f, None))
    within = sum(((f[bins == b] - f[bins == b].mean()) ** 2).sum() for b in np.unique(bins)) / (700 - len(x))
    offset, length = np.average(y, weights=n), gp.curves[0][1]
    signal = max(np.average((y - offset) ** 2, weights=n), (within / n).min())
    kernel = lambda a: signal * np.exp(-0.5 * ((a[:, None] - x[None]) / length) ** 2)
    want = f - offset - kernel(t) @ np.linalg.solve(kernel(x) + np.diag(within / n), y - offset)
    got = {r["rid"]: r["f"] for r in gp.residuals(rows).collect()}
    assert got[5000] is None and np.allclose([got[i] for i in range(700)], want, atol=1e-8)


def test_linear_baseline(spark):
    t = np.random.default_rng(0).uniform(-10, 20, 400)
    x = np.column_stack([t, np.minimum(t, 0), 4 - 4e-4 * t - 9.6e-3 * np.minimum(t, 0)])
    b = statistics.fit_linear(frame(spark, x, ["t", "h", "f"]), ["t", "h"], ["f"])
    assert np.allclose(b.slopes, [[-4e-4, -9.6e-3]], atol=2e-5)
    row = statistics.sensitivity(b, spark, -1e-4).first()
    assert row["sign_ok"] and math.isclose(row["per_k_below"], (-4e-4 - 9.6e-3) / row["reference_hz"], rel_tol=1e-6)
    with pytest.raises(ValueError):
        statistics.fit_linear(frame(spark, np.column_stack([t, 2 * t, t]), ["t", "h", "f"]), ["t", "h"], ["f"])


def test_conformal(spark):
    ref = spark.createDataFrame([(float(i), True) for i in range(1, 10)], "score double, is_ref boolean")
    new = spark.createDataFrame([(s, False) for s in (10.0, 9.0, 5.0, 0.0)], "score double, is_ref boolean")
    got = {r["score"]: r["p_value"] for r in calibration.conformal_p(ref.unionByName(new)).where("not is_ref").collect()}
    assert got == {10.0: 0.1, 9.0: 0.2, 5.0: 0.6, 0.0: 1.0}
    hundred = spark.createDataFrame([(float(i),) for i in range(1, 100)], "score double")
    assert calibration.conformal_limits(hundred, 0.01).first()["control_limit"] == 99
    assert calibration.conformal_limits(hundred, 0.05).first()["control_limit"] == 95
    for n, alpha in ((119, 0.001), (10, 0.0), (10, 1.0)):
        with pytest.raises(ValueError):
            calibration.check_alpha(n, alpha)


def test_cusum_matches_the_recurrence(spark):
    p = np.random.default_rng(5).uniform(0.01, 1, 300)
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(p)]
    got = calibration.cusum_path(spark.createDataFrame(days, "day date, p_value double")).orderBy("day").toPandas()["level"]
    level, want = 0.0, []
    for x in p:
        level = max(0.0, level - math.log(x) - 1.5)
        want.append(level)
    assert np.allclose(got, want)
    flat = spark.createDataFrame([(d, 1 / 131) for d, _ in days[:30]], "day date, p_value double")
    row = calibration.cusum_first_alarm(flat, {"s": ("2020-01-01", "2020-02-01")}, 5.0).first()
    assert row["delay_days"] == 1
    quiet = spark.createDataFrame([(d, 0.5) for d, _ in days[:30]], "day date, p_value double")
    assert calibration.cusum_first_alarm(quiet, {"s": ("2020-01-01", "2020-02-01")}, 5.0).first()["first_alarm"] is None


def test_cusum_thresholds():
    assert [dense.cusum_threshold(n) for n in (130, 99, 180)] == [5.0, 5.0, 5.25]


def test_states(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label, n, shift in (("reference", 40, 0), ("holdout", 400, 0), ("moved", 30, 5)):
        rows += [(f"{label}{i}", label, *map(float, v)) for i, v in enumerate(rng.normal(size=(n, 3)) + shift)]
    samples = spark.createDataFrame(rows, "rid string, label string, x0 double, x1 double, x2 double")
    out = {(r["arm"], r["label"]): r for r in states.evaluate_states(samples, "rid", ["x0", "x1", "x2"], 0.05, detectors.REGISTRY | {"max_deviation": detectors.MaxDeviation}).collect()}
    assert out["raw_frequencies", "holdout"]["alarm_rate"] < 0.1
    assert out["raw_frequencies", "moved"]["alarm_rate"] > 0.9
    assert math.isclose(out["raw_frequencies", "moved"]["median_p_value"], 1 / 41)
    with pytest.raises(ValueError):
        states.evaluate_states(samples, "rid", ["x0"], 0.001)


@pytest.fixture(scope="module")
def record(spark):
    rng = np.random.default_rng(5)
    hours = 24 * 60
    t = 4 + 8 * np.sin(2 * np.pi * np.arange(hours) / 24 / 10) + rng.normal(0, 0.5, hours)
    start = dt.datetime(2020, 1, 1)
    rows, cov = [], []
    for h in range(hours):
        ts = start + dt.timedelta(hours=h)
        cov.append((ts, float(t[h])))
        for m, base in enumerate((2.0, 3.5, 5.0)):
            f = base * (1 - 4e-4 * t[h]) + rng.normal(0, 5e-4)
            if m == 1 and h >= 24 * 50:
                f *= 0.99
            rows.append((ts, m, None if (h, m) == (5, 0) else float(f)))
    return spark.createDataFrame(rows, "ts timestamp, mode int, freq_hz double").cache(), spark.createDataFrame(cov, "ts timestamp, temperature_c double").cache()


def test_protocol(spark, record):
    p = protocol.Protocol(("2020-01-01", "2020-02-10"), ("2020-02-10", "2020-02-20"), ("2020-02-20", "2020-03-01"), alpha=0.05, calibration="in_sample")
    out = protocol.run_protocol(*record, p, only=["raw_frequencies", "temperature_normalized", "pca_residual"])
    assert out["modes"] == [0, 1, 2] and out["reference_days"] == 40
    alarms = {(r["arm"], r["segment"]): r for r in out["alarms"].collect()}
    assert alarms["temperature_normalized", "changed"]["alarm_rate"] == 1.0
    assert alarms["temperature_normalized", "changed"]["delay_days"] == 0
    assert out["ratio"].first()["pattern"] == "local"
    assert {r["segment"]: r["complete_hours"] for r in out["segments"].collect()} == {"reference": 959, "holdout": 240, "changed": 240}
    assert "temperature_normalized" in reports.protocol_markdown(out)
    with pytest.raises(ValueError):
        protocol.run_protocol(*record, protocol.Protocol(p.reference, p.holdout, p.changed, alpha=0.001))
    with pytest.raises(ValueError):
        protocol.run_protocol(*record, protocol.Protocol(p.reference, p.holdout, p.changed, calibration="none"))


def test_sweep_agrees_with_whole_protocols(spark, record):
    p = protocol.Protocol(("2020-01-01", "2020-02-10"), ("2020-02-10", "2020-02-20"), ("2020-02-20", "2020-03-01"), alpha=0.05, calibration="in_sample")
    only = ["raw_frequencies", "temperature_normalized"]
    got = {(r["arm"], r["scenario"], r["shift"]): r["alarm_rate"] for r in protocol.swept_rates(*record, p, [0, 1, 2], {"second": [1], "all": [0, 1, 2]}, [-0.0005, -0.01], only).collect()}
    assert len(got) == 12
    for scenario, moved, shift in (("second", [1], -0.01), ("all", [0, 1, 2], -0.0005)):
        shifted = segments.inject_shift(record[0], *p.holdout, moved, shift)
        alarms = protocol.run_protocol(shifted, record[1], p, [0, 1, 2], only)["alarms"].where("segment = 'holdout'").collect()
        assert {r["arm"]: r["alarm_rate"] for r in alarms} == {a: x for (a, s, d), x in got.items() if (s, d) == (scenario, shift)}


def test_left_out_days_agree_with_refitting(spark, record, monkeypatch):
    frequencies, temperature = record
    few = frequencies.where("ts < '2020-01-12'").join(temperature, "ts")
    complete = segments.complete_hours(few, [0, 1, 2], ["temperature_c"]).withColumn("humidity", F.hour("ts") * 1.0 % 7).cache()
    days = complete.select(F.to_date("ts").alias("day")).distinct().where("day in ('2020-01-01', '2020-01-05')").cache()
    for arm in ("raw_frequencies", "temperature_normalized", "gp_normalized", "pca_residual", "knn", "cointegration", "environment_normalized"):
        got = protocol.left_out_days(arm, complete, days, ["m0", "m1", "m2"], ["humidity"]).orderBy("day").toPandas()["score"].to_numpy()
        if arm != "cointegration":  # a fold there also loses the step over the gap
            monkeypatch.setattr(protocol, "FOLD_ROWS", 0)
            want = protocol._left_out_by_spark(arm, complete, days, ["m0", "m1", "m2"], ["humidity"]).orderBy("day").toPandas()["score"].to_numpy()
            monkeypatch.undo()
            assert np.allclose(got, want, rtol=1e-6), arm
        assert len(got) == 2 and (got > 0).all()


def test_segments(spark):
    times = ["2019-12-31 23:00:00", "2020-01-01 00:00:00", "2020-01-01 12:00:00", "2020-01-02 00:00:00", "2020-01-03 00:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in rows.orderBy("t").select(segments.in_segment("t", "2020-01-01", "2020-01-02")).collect()] == [False, True, True, False, False]
    shifted = segments.inject_shift(spark.createDataFrame([(dt.datetime(2020, 1, 1), m, 2.0) for m in (0, 1)], "ts timestamp, mode int, freq_hz double"), "2020-01-01", "2020-01-02", [1], -0.01)
    assert {r["mode"]: r["freq_hz"] for r in shifted.collect()} == {0: 2.0, 1: 1.98}
    sweep = spark.createDataFrame([("a", s, x) for s, x in ((-0.001, 0.2), (-0.005, 0.95), (-0.02, 1.0))], "arm string, shift double, alarm_rate double")
    assert protocol.detectable_shift(sweep, ["arm"]).first()["detectable_shift"] == 0.005


def test_moments_skip_incomplete_rows(spark):
    whole = [(1.0, 2.0), (2.0, 1.0), (4.0, 6.0)]
    a = statistics.moments(spark.createDataFrame(whole, "x double, y double"), ["x", "y"])
    b = statistics.moments(spark.createDataFrame([*whole, (None, None), (9.0, None)], "x double, y double"), ["x", "y"])
    assert a.n == b.n == 3 and np.allclose(a.covariance, b.covariance) and a.fourth == pytest.approx(b.fourth)
