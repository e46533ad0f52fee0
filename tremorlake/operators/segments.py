"""Rows by time segment, completeness, windows and label routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite

MAX_MISSING = 0.10


def in_segment(ts: str | Column, start, end) -> Column:
    """start <= ts < end."""
    return (col(ts) >= F.lit(start).cast("timestamp")) & (col(ts) < F.lit(end).cast("timestamp"))


def in_segment_days(day: str | Column, start, end) -> Column:
    """By calendar day: the bounds' times of day don't count."""
    return (col(day) >= F.to_date(F.lit(start))) & (col(day) < F.to_date(F.lit(end)))


def segment_of(day: str | Column, segments: dict[str, tuple[str, str]]) -> Column:
    """The name of the segment that holds a day, or null."""
    out = None
    for name, (start, end) in segments.items():
        inside = in_segment_days(day, start, end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def select_modes(record: DataFrame, hours: DataFrame, limit: float = MAX_MISSING) -> DataFrame:
    """Modes of ``record(ts, mode, freq_hz)`` that are missing in at most ``limit`` of the given reference hours."""
    n = hours.select("ts").distinct().agg(F.count("*").alias("_hours"))
    seen = record.join(hours.select("ts").distinct(), "ts", "left_semi").where(F.col("freq_hz").isNotNull()).groupBy("mode").agg(F.countDistinct("ts").alias("_seen"))
    share = 1 - F.col("_seen") / F.col("_hours")
    return record.select("mode").distinct().join(seen, "mode", "left").fillna(0, ["_seen"]).join(F.broadcast(n)).select("mode", share.alias("missing_share")).where(F.col("missing_share") <= limit)


def complete_hours(record: DataFrame, modes: list, covariates: list[str] = ()) -> DataFrame:
    """Wide rows ``ts, m<mode>..., covariates`` of the hours in which every mode and covariate is present."""
    wide = record.groupBy("ts", *covariates).pivot("mode", list(modes)).agg(F.first(finite("freq_hz"), ignorenulls=True))
    wide = wide.select("ts", *covariates, *[F.col(str(m)).alias(f"m{m}") for m in modes])
    return wide.dropna(subset=[*covariates, *[f"m{m}" for m in modes]])


def tumbling(signal: DataFrame, keys: list[str], length: int, trim: int) -> DataFrame:
    """``window`` of each sample: windows of ``length`` samples after ``trim`` samples, none that reaches into the last ``trim``."""
    n = F.max("idx").over(Window.partitionBy(*keys)) + 1
    window = F.floor((F.col("idx") - trim) / length).cast("bigint")
    inside = (F.col("idx") >= trim) & ((window + 1) * length + trim <= F.col("_n") - trim)
    return signal.withColumn("_n", n).where(inside).withColumn("window", window).drop("_n")


def steady_windows(windows: DataFrame, keys: list[str], value: str, share: float = 0.9) -> DataFrame:
    """Windows whose population deviation is at least ``share`` of the median over the windows of the same keys."""
    sd = windows.groupBy(*keys, "window").agg(F.stddev_pop(value).alias("sd"))
    middle = sd.groupBy(*keys).agg(F.median("sd").alias("_middle"))
    joined = sd.join(middle, keys) if keys else sd.crossJoin(F.broadcast(middle))
    return joined.where(F.col("sd") >= share * F.col("_middle")).drop("_middle")


def route_label(ts: str | Column, reference: tuple[str, str], holdout_end: str, event: str) -> Column:
    """Label of an event record: reference, holdout until the event, the event itself, and changed for all else, earlier records included."""
    t, stamp = col(ts), lambda x: F.lit(x).cast("timestamp")
    return (
        F.when(in_segment(t, *reference), "reference")
        .when(t == stamp(event), "event")
        .when((t >= stamp(reference[1])) & (t < stamp(holdout_end)), "holdout")
        .otherwise("changed")
    )


def inject_shift(record: DataFrame, start, end, modes: list, shift: float) -> DataFrame:
    """The record with the frequencies of some modes scaled by 1 + shift inside a segment."""
    return record.withColumn("freq_hz", F.when(in_segment("ts", start, end) & F.col("mode").isin(list(modes)), F.col("freq_hz") * (1 + shift)).otherwise(F.col("freq_hz")))
