"""Shear-building models as rows: frequencies, and how well measured modes agree with them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dense import shear_frequencies
from .spectral import pair_modes


def checked(models: DataFrame) -> DataFrame:
    """Fails on a model without stories, of unequal lengths, or with a value that isn't positive."""
    good = (F.size("masses") > 0) & (F.size("masses") == F.size("stiffness")) & F.forall("masses", lambda x: x > 0) & F.forall("stiffness", lambda x: x > 0)
    return models.withColumn("masses", F.when(good, F.col("masses")).otherwise(F.raise_error(F.lit("a shear model needs as many positive masses as positive stiffnesses, one at least"))))


def natural_frequencies(models: DataFrame) -> DataFrame:
    """Adds ``frequencies_hz``, ascending, to rows with ``masses`` and ``stiffness``."""

    @F.pandas_udf("array<double>")
    def frequencies(masses: pd.Series, stiffness: pd.Series) -> pd.Series:
        return pd.Series([shear_frequencies(m, k) for m, k in zip(masses, stiffness)])

    return checked(models).withColumn("frequencies_hz", frequencies("masses", "stiffness"))


def stiffness_matrix(models: DataFrame) -> DataFrame:
    """Adds ``matrix``: tridiagonal, each storey's spring and the one above it on the diagonal."""
    k = F.col("stiffness")
    i = F.sequence(F.lit(1), F.size(k))
    above = lambda x: F.coalesce(F.try_element_at(k, x + 1), F.lit(0.0))
    cell = lambda a, b: F.when(a == b, F.element_at(k, a) + above(a)).when(F.abs(a - b) == 1, -F.element_at(k, F.greatest(a, b))).otherwise(F.lit(0.0))
    return models.withColumn("matrix", F.transform(i, lambda a: F.transform(i, lambda b: cell(a, b))))


def model_consistency(model: DataFrame, measured: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each structure that ``keys`` name) from ``model(ref_id, ref_hz)`` and ``measured(obs_id, obs_hz)``: the median squared ratio and its spread in percent; nulls without pairs."""
    paired = pair_modes(model, measured, keys).select(*keys, F.pow(F.col("obs_hz") / F.col("ref_hz"), 2).alias("r"))
    median, count = F.median("r").alias("stiffness_ratio"), F.count("*").alias("paired")
    away = (100 * F.median(F.abs(F.col("r") - F.col("stiffness_ratio"))) / F.max("stiffness_ratio")).alias("spread_percent")
    if keys:  # a structure's pairs lie in one task already, and are few
        whole = Window.partitionBy(*keys)
        both = paired.select("*", F.median("r").over(whole).alias("stiffness_ratio"))
        return both.groupBy(*keys).agg(F.max("stiffness_ratio").alias("stiffness_ratio"), count, away)
    middle = paired.agg(median, count)
    return middle.crossJoin(paired.crossJoin(F.broadcast(middle)).agg(away))  # one row
