"""Conformal p-values and limits, alarm summaries and the CUSUM of daily evidence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import in_segment_days

ALPHA = 0.01
DRIFT = 1.5


def check_alpha(reference: int, alpha: float) -> None:
    """Refuses a rate that is no probability, or that ``reference`` scores can't support."""
    if not 0 < alpha < 1:
        raise ValueError(f"the false-alarm rate must lie between 0 and 1, not at {alpha}")
    if alpha < 1 / (reference + 1):
        raise ValueError(f"a false-alarm rate of {alpha} takes {math.ceil(1 / alpha - 1)} reference scores; there are {reference}")


def conformal_p(scores: DataFrame, keys: list[str] = (), calibration: DataFrame | None = None) -> DataFrame:
    """Adds ``p_value`` = (1 + reference scores of at least this one) / (reference scores + 1), within ``keys``.

    ``scores`` has ``is_ref``; the reference scores are those rows, or the rows of ``calibration`` (keys, score).
    The window of a key runs over its distinct scores, counted first: days or samples, thousands of them, not the
    rows they were made from. Rows get their rank by a join on the score.
    """
    keys = list(keys)
    reference = (scores.where("is_ref").select(*keys, "score") if calibration is None else calibration.select(*keys, "score")).where(F.col("score").isNotNull())
    counted = scores.select(*keys, "score").distinct().withColumn("_n", F.lit(0)).unionByName(reference.groupBy(*keys, "score").agg(F.count("*").cast("int").alias("_n")))
    counted = counted.groupBy(*keys, "score").agg(F.sum("_n").alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    ranked = counted.withColumn("_above", F.sum("_n").over(down.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    ranked = ranked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("score").alias("_score"), "_above", "_all")
    same = F.col("score").eqNullSafe(F.col("_score"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return scores.join(ranked, same, "left").withColumn("p_value", F.when(F.col("score").isNotNull(), (1.0 + F.col("_above")) / (1.0 + F.col("_all")))).drop("_score", "_above", "_all", *[f"_k{i}" for i in range(len(keys))])


def conformal_limits(reference: DataFrame, alpha: float, keys: list[str] = ()) -> DataFrame:
    """``keys, n_ref, control_limit``: the k-th smallest reference score, k = ceil((n + 1)(1 - alpha)); null where alpha asks too much."""
    w = Window.partitionBy(*keys)
    ranked = reference.where(F.col("score").isNotNull()).withColumn("_r", F.row_number().over(w.orderBy("score"))).withColumn("n_ref", F.count("*").over(w))
    k = F.ceil((F.col("n_ref") + 1) * F.lit(1 - alpha) - 1e-9)
    return ranked.groupBy(*keys, "n_ref").agg(F.max(F.when(F.col("_r") == k, F.col("score"))).alias("control_limit"))


def by_segment(daily: DataFrame, segments: dict[str, tuple[str, str]]) -> DataFrame:
    """The days with the name and ``_start`` of every segment they lie in, in one pass; a day in none goes."""
    named = [F.when(in_segment_days("day", start, end), F.struct(F.lit(name).alias("segment"), F.lit(start).alias("_start"))) for name, (start, end) in segments.items()]
    return daily.withColumn("_in", F.explode(F.filter(F.array(*named), lambda s: s.isNotNull()))).select(*daily.columns, "_in.*")


def alarm_summary(daily: DataFrame, alpha: float, segments: dict[str, tuple[str, str]], keys: list[str] = ()) -> DataFrame:
    """One row per key and segment from ``day, score, p_value, control_limit``; an empty segment has no row."""
    alarmed = F.col("p_value") <= alpha + 1e-12
    first = F.min(F.when(alarmed, F.col("day")))
    out = by_segment(daily, segments).groupBy(*keys, "segment", "_start").agg(
        F.count("*").alias("days"),
        F.count_if(alarmed).alias("alarmed_days"),
        first.alias("first_alarm"),
        F.datediff(first, F.to_date("_start")).cast("bigint").alias("delay_days"),
        F.min("p_value").alias("min_p_value"),
        F.min(F.col("score") / F.col("control_limit")).alias("min_over_limit"),
        F.max(F.col("score") / F.col("control_limit")).alias("max_over_limit"),
    )
    return out.drop("_start").withColumn("alarm_rate", F.col("alarmed_days") / F.col("days"))


def cusum_path(daily: DataFrame, keys: list[str] = (), drift: float = DRIFT) -> DataFrame:
    """Adds ``level``: the sum of -ln(p) - drift, floored at 0, in day order. As a running sum minus its running minimum."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    path = daily.withColumn("_sum", F.sum(-F.log("p_value") - drift).over(w))
    return path.withColumn("level", F.col("_sum") - F.least(F.lit(0.0), F.min("_sum").over(w))).drop("_sum")


def cusum_first_alarm(daily: DataFrame, segments: dict[str, tuple[str, str]], threshold: float, keys: list[str] = (), drift: float = DRIFT) -> DataFrame:
    """First day of each segment whose level reaches the threshold, its delay, and the peak: the level then, else the largest."""
    path = cusum_path(by_segment(daily, segments), [*keys, "segment"], drift)
    over = F.col("level") >= threshold
    out = path.groupBy(*keys, "segment", "_start").agg(
        F.min(F.when(over, F.col("day"))).alias("first_alarm"), F.min_by(F.when(over, F.col("level")), F.when(over, F.col("day"))).alias("_at"), F.max("level").alias("_top")
    )
    delay = F.datediff("first_alarm", F.to_date("_start")).cast("bigint")
    return out.select(*keys, "segment", "first_alarm", delay.alias("delay_days"), F.coalesce("_at", "_top").alias("peak"))
