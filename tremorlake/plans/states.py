"""Labelled states: every arm fitted on the reference samples, calibrated leave-one-out, summarised per label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staged import written
from ..operators import calibration, detectors
from ..operators.selection import medians


def evaluate_states(samples: DataFrame, row_id: str, features: list[str], alpha: float, arms: dict | None = None) -> DataFrame:
    """``arm, label, samples, alarmed, alarm_rate, median_p_value, median_over_limit`` for every label but ``reference``."""
    samples = written(samples.select(row_id, "label", *features))  # every arm reads it several times
    reference = samples.where(F.col("label") == "reference")
    calibration.check_alpha(reference.count(), alpha)
    others, judged = samples.where(F.col("label") != "reference"), None
    for name, arm in (detectors.REGISTRY if arms is None else arms).items():
        scores = arm.fit(reference, features).score(others).select("label", "score").withColumn("is_ref", F.lit(False))
        healthy = written(detectors.leave_one_out(arm, reference, row_id, features))
        limit = calibration.conformal_limits(healthy, alpha)
        part = calibration.conformal_p(scores, calibration=healthy).crossJoin(F.broadcast(limit)).select(F.lit(name).alias("arm"), "label", "score", "p_value", "control_limit")
        judged = part if judged is None else judged.unionByName(part)
    judged = written(judged)
    alarmed = F.col("p_value") <= alpha + 1e-12
    out = judged.groupBy("arm", "label").agg(F.count("*").alias("samples"), F.count_if(alarmed).alias("alarmed"), F.avg(alarmed.cast("double")).alias("alarm_rate"), F.max("control_limit").alias("_limit"))
    both = judged.select("arm", "label", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("p_value").alias("v")), F.struct(F.lit("score").alias("kind"), F.col("score").alias("v")))).alias("x")).select("arm", "label", "x.*")
    middle = medians(both, ["arm", "label", "kind"], "v").groupBy("arm", "label").agg(*[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(f"_{k}") for k in ("p", "score")])
    return out.join(middle, ["arm", "label"], "left").select("arm", "label", "samples", "alarmed", "alarm_rate", F.col("_p").alias("median_p_value"), (F.col("_score") / F.col("_limit")).alias("median_over_limit"))
