"""Plans whose tasks keep their size as the tables grow."""

import os

import pytest

from tremorlake.functions import staged
from tremorlake.operators import physical
from tremorlake.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count(name)


@tables
def test_rows_of_a_part_are_dealt_over_more_tasks_in_larger_tables(spark, monkeypatch):
    monkeypatch.setattr(staged, "TASK_ROWS", 1000)
    reference, observed = queries.mode_tables(spark, SF)
    assert reference.rdd.getNumPartitions() == observed.rdd.getNumPartitions() == 60


def test_consistency_pairs_once(spark):
    rows = [(p, i, 1.0 + i + p / 10) for p in range(3) for i in range(3)]
    model, seen = spark.createDataFrame(rows, "part int, ref_id int, ref_hz double"), spark.createDataFrame([(p, i, 0.9 * x) for p, i, x in rows], "part int, obs_id int, obs_hz double")
    out = physical.model_consistency(model, seen, ["part"])
    assert nodes(out, "Join") == 1
    assert [(r.part, round(r.stiffness_ratio, 9), r.paired, round(r.spread_percent, 9)) for r in out.orderBy("part").collect()] == [(p, 0.81, 3, 0.0) for p in range(3)]


def test_cross_spectra_meet_without_a_join_of_spectra(spark):
    """Segments are shuffled once with all channels; only their sums are dealt out again."""
    from tremorlake.operators import modal

    rows = [(r, i, [float((i * 7 + r) % 11), float(i % 5)]) for r in range(2) for i in range(300)]
    samples = spark.createDataFrame(rows, "record int, idx int, channels array<double>")
    assert nodes(modal.fdd(samples, 100.0, 128), "Join") == 1  # of samples and their counts


def test_periodogram_makes_its_bins_without_a_second_pass(spark):
    from tremorlake.operators import spectral

    signal = spark.createDataFrame([(s, i, float((i * 5 + s) % 7)) for s in range(3) for i in range(12)] + [(None, 0, 1.0)], "series int, idx int, value double")
    dft = spectral.periodogram_dft(signal, 100.0)
    assert nodes(dft, "Join") == 0
    key = lambda df: sorted((r.series, r.bin, round(r.freq_hz, 6), round(r.power, 6)) for r in df.collect())
    assert key(dft) == key(spectral.periodogram(signal.where("series is not null"), 100.0))


def test_meetings_leave_a_task_in_small_frames(spark, monkeypatch):
    """A task's Python holds a bounded number of bounds and of copied queries, and the answers stay exact."""
    import numpy as np
    from pyspark.sql import functions as F

    from tremorlake.operators import neighbours

    monkeypatch.setattr(neighbours, "RING_ROWS", 8)
    monkeypatch.setattr(neighbours, "CELLS", 200)
    monkeypatch.setattr(neighbours, "SENT", 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 6)), np.ones((20, 6))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid bigint, v array<double>")
    index = neighbours.PivotIndex.build(rows, "qid")
    asked = rows.select("qid", "v", F.lit(None).cast("array<double>").alias("ratio"), F.col("qid").alias("skip"))
    sizes = []
    frame = type(asked)
    real = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, fn, schema: sizes.extend(len(p) for p in fn(iter([self.toPandas()]))) or real(self, fn, schema))
    index._meetings(asked, 3, False)
    assert sizes and max(sizes) <= 7
    monkeypatch.setattr(frame, "mapInPandas", real)
    found = {r.qid: r.mean for r in index.nearest(asked, 3).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    assert np.allclose([found[i] for i in range(len(x))], np.sort(far, axis=1)[:, :3].mean(axis=1), atol=1e-12)


@tables
def test_protocol_ranks_scores_that_are_settled(spark):
    """Ranks are joined by the score itself: folds summed again in another order would lose their days."""
    from tremorlake.plans.protocol import Protocol, run_protocol

    out = run_protocol(*queries.protocol_tables(spark, SF), Protocol(*queries.PROTOCOL_SEGMENTS.values(), alpha=0.1), [0], ["raw_frequencies", "temperature_normalized"])
    assert nodes(out["daily"], "MapInPandas") == 0
    assert out["daily"].where("p_value is null").count() == 0
