"""Daily medians and means, moments, regression, robust scales, noise split and frequency checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import centred, finite, total
from ..functions.dense import dependent
from .selection import medians

MIN_HOURS = 6


def daily_medians(scores: DataFrame, keys: list[str] = (), min_hours: int = MIN_HOURS) -> DataFrame:
    """``keys, day, score, n``: exact medians of the finite scores of each day that has enough of them."""
    return (
        scores.withColumn("score", finite("score"))
        .where(F.col("score").isNotNull())
        .groupBy(*keys, F.to_date("ts").alias("day"))
        .agg(F.median("score").alias("score"), F.count("*").alias("n"))
        .where(F.col("n") >= min_hours)
    )


def daily_means(rows: DataFrame, features: list[str], min_hours: int = MIN_HOURS, keys: list[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, F.to_date("ts").alias("day")).agg(*[F.avg(f).alias(f) for f in features], F.count("*").alias("n")).where(F.col("n") >= min_hours)


@dataclass
class Moments:
    """Count, mean, population covariance and sum of fourth powers of the centred norm."""

    n: float
    mean: np.ndarray
    covariance: np.ndarray
    fourth: float


def means(rows: DataFrame, features: list[str]) -> tuple[int, np.ndarray]:
    got = rows.agg(F.count("*"), *[F.avg(f) for f in features]).first()
    return got[0], np.array([np.nan if x is None else x for x in got[1:]], float)


def moments(rows: DataFrame, features: list[str]) -> Moments:
    """Two small aggregations over the rows that have all features; sums of squares are centred, so nothing cancels."""
    rows = rows.dropna(subset=features)
    n, mean = means(rows, features)
    if not n:
        raise ValueError("no row to fit on")
    z, p = centred(features, mean), len(features)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    norm = total([x * x for x in z])
    got = rows.agg(*[F.sum(z[i] * z[j]) for i, j in pairs], F.sum(norm * norm)).first()
    covariance = np.zeros((p, p))
    for (i, j), s in zip(pairs, got):
        covariance[i, j] = covariance[j, i] = s / n
    return Moments(n, mean, covariance, got[-1])


def vector(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def spreads(rows: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population deviations of the rows that have all features, by one aggregation per place of their vector."""
    values = rows.dropna(subset=features).select(F.posexplode(vector(features)).alias("place", "v"))
    got = sorted(values.groupBy("place").agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).collect())  # one row per feature
    if not got:
        raise ValueError("no row to fit on")
    return got[0][1], np.array([r[2] for r in got], float), np.array([r[3] for r in got], float)


@dataclass
class LinearBaseline:
    """Targets as a linear function of covariates around their reference means."""

    covariates: list[str]
    targets: list[str]
    centre: np.ndarray
    level: np.ndarray
    slopes: np.ndarray  # (targets, covariates)

    def predict(self, target: int) -> Column:
        return F.lit(float(self.level[target])) + total([x * float(b) for x, b in zip(centred(self.covariates, self.centre), self.slopes[target])])

    def residuals(self, rows: DataFrame) -> DataFrame:
        """The rows with every target replaced by its residual."""
        return rows.withColumns({t: F.col(t) - self.predict(i) for i, t in enumerate(self.targets)})


class Dependent(ValueError):
    """The covariates depend on each other, so there is no single fit."""


def fit_linear(rows: DataFrame, covariates: list[str], targets: list[str]) -> LinearBaseline:
    """Least squares from joint moments; covariates that depend on each other are refused."""
    joint = moments(rows, [*covariates, *targets])
    k = len(covariates)
    sxx, sxy = joint.covariance[:k, :k], joint.covariance[:k, k:]
    if dependent(sxx):
        raise Dependent("the covariates are linearly dependent")
    return LinearBaseline(list(covariates), list(targets), joint.mean[:k], joint.mean[k:], np.linalg.solve(sxx, sxy).T)


def sensitivity(baseline: LinearBaseline, spark, expected: float | None = None) -> DataFrame:
    """Relative change per kelvin above and below the hinge of a bilinear baseline, one row per target."""
    rows = []
    for name, level, slope in zip(baseline.targets, baseline.level, baseline.slopes):
        above, below = float(slope[0] / level), float(slope.sum() / level)
        rows.append((name, float(level), above, below, above < 0, None if expected is None else above / expected))
    return spark.createDataFrame(rows, "target string, reference_hz double, per_k_above double, per_k_below double, sign_ok boolean, ratio_to_material double")


def robust_scales(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, centre, scale``: median and 1.4826 times the median absolute deviation; no task holds a group."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    centre = medians(rows, keys, value, "centre").withColumn("_k", group).drop(*keys, "n")
    joined = rows.withColumn("_g", group).join(centre, F.col("_g") == F.col("_k")).drop("_g", "_k")
    spread = medians(joined, [*keys, "centre"], F.abs(F.col(value) - F.col("centre")), "_mad")
    return spread.select(*keys, "centre", (1.4826 * F.col("_mad")).alias("scale"))


def erratic(rows: DataFrame, keys: list[str], unit: str, value: str, limit: float = 10.0) -> DataFrame:
    """Units one of whose features has a sample deviation of more than ``limit`` robust scales."""
    spread = rows.groupBy(*keys).agg(F.stddev_samp(value).alias("sd"))
    return spread.join(robust_scales(rows, keys, value), keys).groupBy(unit).agg(F.max(F.col("sd") > limit * F.col("scale")).alias("erratic")).where("erratic").select(unit)


def stable_channels(rms: DataFrame, limit: float = 10.0) -> DataFrame:
    """Channels of ``rms(channel, ts, rms)`` whose largest monthly median is at most ``limit`` times the smallest."""
    monthly = medians(rms.withColumn("month", F.date_format("ts", "yyyy-MM")), ["channel", "month"], "rms", "rms")
    return monthly.groupBy("channel").agg((F.max("rms") / F.greatest(F.min("rms"), F.lit(1e-12))).alias("ratio")).where(F.col("ratio") <= limit)


def noise_split(residuals: DataFrame, keys: list[str], value: str, step_s: int = 3600) -> DataFrame:
    """Identification noise from differences of rows exactly ``step_s`` apart, total variance and their ratio (1 at most)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    step = F.when(gap == step_s, F.col(value) - F.lag(value).over(w))
    out = residuals.withColumn("_step", step).groupBy(*keys).agg(
        F.count("_step").alias("pairs"), F.sqrt(F.avg(F.col("_step") * F.col("_step")) / 2).alias("noise_sigma"), F.stddev_pop(value).alias("total_sigma")
    )
    return out.withColumn("noise_share", F.least(F.pow(F.col("noise_sigma") / F.col("total_sigma"), 2), F.lit(1.0)))


def frequency_ratio(pairs: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """From ``pairs(mode, reference_hz, changed_hz)``: one row that says whether a change is global (one sign, little spread) or local."""
    shift = (F.col("changed_hz") - F.col("reference_hz")) / F.col("reference_hz")
    out = pairs.withColumn("shift", shift).agg(
        (F.min("shift") > 0).alias("_up"), (F.max("shift") < 0).alias("_down"), (F.max("shift") - F.min("shift")).alias("spread"), F.avg(F.abs("shift")).alias("mean_abs_shift")
    )
    same = F.col("_up") | F.col("_down")
    local = ~same | (F.col("spread") > tolerance * F.col("mean_abs_shift"))
    return out.select(same.alias("same_sign"), "spread", "mean_abs_shift", F.when(local, "local").otherwise("global").alias("pattern"))


def ratio_changes(pairs: DataFrame) -> DataFrame:
    """Per mode: relative shift, and the change of its frequency's ratio to the first mode's."""
    first = pairs.agg(F.min_by("reference_hz", "mode").alias("_r"), F.min_by("changed_hz", "mode").alias("_c"))
    return pairs.crossJoin(F.broadcast(first)).select(
        "mode",
        ((F.col("changed_hz") - F.col("reference_hz")) / F.col("reference_hz")).alias("relative_shift"),
        ((F.col("changed_hz") / F.col("_c")) / (F.col("reference_hz") / F.col("_r")) - 1).alias("ratio_change"),
    )


def shifts_over_sigma(samples: DataFrame, reference: str = "reference") -> DataFrame:
    """From ``samples(label, feature, value)``: medians against the reference's, relative and over its sample deviation."""
    middle = medians(samples.where(F.col("label").isNotNull()), ["label", "feature"], "value")  # of both at once
    sigma = samples.where(F.col("label") == reference).groupBy("feature").agg(F.stddev_samp("value").alias("sigma"))
    base = middle.where(F.col("label") == reference).select("feature", F.col("median").alias("reference_median")).join(sigma, "feature")
    state = middle.where(F.col("label") != reference).select("label", "feature", "median")
    gap = F.col("median") - F.col("reference_median")
    return state.join(base, "feature").select("label", "feature", (gap / F.col("reference_median")).alias("relative_shift"), (gap / F.col("sigma")).alias("shift_over_sigma"))


def top_shifts(shifts: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.abs("shift_over_sigma").desc(), "feature")
    return shifts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
