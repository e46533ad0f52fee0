"""Features of bridge openings: strain changes at fixed inclinations against the closed level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLOSED_SAMPLES, STARTED_DEG, ANGLES, TOLERANCE_DEG = 2000, 1.0, (-30.0, -60.0), 1.0
DEAD = -1_000_000.0


def dead_channels(samples: DataFrame) -> DataFrame:
    """Channels of ``samples(file, idx, inclination, channel, value)`` that hold the dead value anywhere; they go from every event."""
    return samples.where(F.col("value") == DEAD).select("channel").distinct()


def opening_features(samples: DataFrame, angles: tuple[float, ...] = ANGLES, closed_samples: int = CLOSED_SAMPLES) -> DataFrame:
    """``file, angle, channel, feature``: median strain near each angle on the way up, less its closed median.

    The way up runs from the first sample more than a degree below the closed inclination to the lowest
    one after it. A file that lacks samples near any angle gives no rows.
    """
    line = samples.select("file", "idx", "inclination").distinct()
    closed = line.where(F.col("idx") < closed_samples).groupBy("file").agg(F.median("inclination").alias("_closed"))
    started = line.join(closed, "file").where(F.col("inclination") < F.col("_closed") - STARTED_DEG)
    first = started.groupBy("file").agg(F.min("idx").alias("_from"))
    lowest = line.join(first, "file").where(F.col("idx") >= F.col("_from")).groupBy("file", "_from").agg(F.min(F.struct("inclination", "idx")).alias("_m")).select("file", "_from", F.col("_m.idx").alias("_to"))
    level = samples.where(F.col("idx") < closed_samples).groupBy("file", "channel").agg(F.median("value").alias("_level"))
    angle = F.explode(F.array(*[F.lit(a) for a in angles])).alias("angle")
    way = samples.join(lowest, "file").where(F.col("idx").between(F.col("_from"), F.col("_to"))).select("*", angle).where(F.abs(F.col("inclination") - F.col("angle")) <= TOLERANCE_DEG)
    at = way.groupBy("file", "angle", "channel").agg(F.median("value").alias("_value"))
    full = at.groupBy("file").agg(F.countDistinct("angle").alias("_n")).where(F.col("_n") == len(angles)).select("file")
    return at.join(full, "file").join(level, ["file", "channel"]).select("file", "angle", "channel", (F.col("_value") - F.col("_level")).alias("feature"))


def feature_order(features: DataFrame) -> DataFrame:
    """``file, features``: the features as one vector, by angle in the given order from the mildest, then by channel."""
    w = F.array_sort(F.collect_list(F.struct((-F.col("angle")).alias("a"), F.col("channel").alias("c"), F.col("feature").alias("f"))))
    return features.groupBy("file").agg(F.transform(w, lambda x: x["f"]).alias("features"))


def opening_summary(samples: DataFrame, rate_hz: float = 200.0) -> DataFrame:
    """``file, duration_s, min_inclination_deg``."""
    line = samples.select("file", "idx", "inclination").distinct()
    return line.groupBy("file").agg((F.count("*") / rate_hz).alias("duration_s"), F.min("inclination").alias("min_inclination_deg"))


def with_positions(samples: DataFrame) -> DataFrame:
    """``idx`` from the time order of each file's rows."""
    return samples.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("ts")) - 1)
