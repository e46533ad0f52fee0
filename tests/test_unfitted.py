"""Covariates that depend on each other, in one fold or in the whole reference: no fit, so scores above every other, as in the SQL."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import folds
from tremorlake.operators import statistics
from tremorlake.plans import protocol, queries

def rows(names, found):
    cell = lambda x: round(float(x), 6) if isinstance(x, float) else x
    return sorted(repr(sorted(zip(names, map(cell, r)))) for r in found)


NAMES = ("protocol_alarms", "protocol_alarm_rates", "detectable_shift")


@pytest.fixture(params=[0, 1, 2], ids=lambda n: f"{n} reference days above the hinge")
def events(request, spark, tmp_path):
    """Two events an hour, eight hours a day. Minutes and values are such that all sums of the SQL are exact, so a determinant is 0 where it should be."""
    rng, out = np.random.default_rng(3), []
    for day in range(30):
        for hour in range(8):
            minute = 38 if hour == 2 and day in (4, 9)[: request.param] else int(rng.choice([6, 14, 22, 26]))
            level = 100 + 0.25 * int(rng.integers(-40, 40)) + 0.5 * (minute - 30) - 0.25 * (day > 22) * 200
            for x in (-1.0, 1.0):
                out.append((dt.datetime(2024, 1, 1 + day, hour, minute, 5), level + x))
    spark.createDataFrame(out, "ts timestamp, value double").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return str(tmp_path), con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, events, name):
    got, want = queries.QUERIES[name](spark, events[0]), events[1].execute(queries.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("limit", [500_000, 0])
def test_a_day_that_alone_holds_one_side_of_the_hinge_has_no_fit(spark, monkeypatch, limit):
    monkeypatch.setattr(protocol, "FOLD_ROWS", limit)
    rng = np.random.default_rng(1)
    hours = [(dt.datetime(2024, 1, 1 + d, h), float(5 * (d == 2 and h == 3) - 4 + rng.normal() * 0.1), float(rng.normal())) for d in range(4) for h in range(8)]
    train = spark.createDataFrame(hours, "ts timestamp, temperature_c double, m0 double").cache()
    days = train.select(F.to_date("ts").alias("day")).distinct()
    got = {r["day"].day: r["score"] for r in protocol.left_out_days("temperature_normalized", train, days, ["m0"]).collect()}
    assert np.isnan(got.pop(3)) and len(got) == 3 and np.isfinite(list(got.values())).all()


def test_dependent_covariates_are_refused():
    t = np.arange(6.0)
    assert folds.linear_residuals(np.column_stack([t, t]), t[:, None] ** 2, np.ones(6, bool)) is None
    assert issubclass(statistics.Dependent, ValueError)
