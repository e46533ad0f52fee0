"""Bridge openings: strain features per event, erratic gauges, labelled states and the largest shifts.

python -m tremorlake.plans.openings --fetch --source openings.zip --features features --inclination tilt --gauges g1 g2
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import event_time
from ..operators import detectors, events, segments, statistics
from ..sources import texts
from . import reports
from .states import evaluate_states


def labelled_features(samples: DataFrame, times: DataFrame, reference: tuple[str, str], holdout_end: str, event: str) -> DataFrame:
    """``file, label, channel, angle, feature`` without dead channels; ``times(file, start_ts)``."""
    alive = samples.join(F.broadcast(events.dead_channels(samples)), "channel", "left_anti")
    label = segments.route_label("start_ts", reference, holdout_end, event)
    return events.opening_features(alive).join(F.broadcast(times), "file").withColumn("label", label)


def run_study(features: DataFrame, alpha: float = 0.05, max_deviation: bool = False, without_erratic: bool = False) -> dict[str, DataFrame]:
    reference = features.where(F.col("label") == "reference")
    erratic = statistics.erratic(reference, ["channel", "angle"], "channel", "feature")
    if without_erratic:
        features = features.join(F.broadcast(erratic), "channel", "left_anti")
    named = features.withColumn("name", F.concat_ws("_", F.col("channel"), F.abs("angle").cast("int").cast("string")))
    names = [r[0] for r in named.select("name", "angle", "channel").distinct().orderBy(F.desc("angle"), "channel").select("name").collect()]  # gauges times angles
    wide = named.groupBy("file", "label").pivot("name", names).agg(F.first("feature")).dropna()
    arms = detectors.REGISTRY | ({"max_deviation": detectors.MaxDeviation} if max_deviation else {})
    shifts = statistics.shifts_over_sigma(named.select("label", F.col("name").alias("feature"), F.col("feature").alias("value")))
    return {"erratic": erratic, "features": wide, "states": evaluate_states(wide, "file", names, alpha, arms), "top_shifts": statistics.top_shifts(shifts)}


def samples_of(spark: SparkSession, source: str, inclination: str, gauges: list[str]) -> DataFrame:
    """``file, idx, inclination, channel, value`` of the CSV members of zip files; a missing value drops its sample."""
    wide = texts.zipped_csvs(spark, source, [inclination, *gauges])
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("channel"), F.col(f"`{g}`").alias("value")) for g in gauges])).alias("c")
    return wide.select("file", "idx", F.col(f"`{inclination}`").alias("inclination"), cells).select("file", "idx", "inclination", "c.*").dropna()


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--features", required=True, help="Parquet with file, label, channel, angle, feature")
    a.add_argument("--fetch", action="store_true", help="make the features from --source first; no samples are kept")
    a.add_argument("--source", help="zip files of CSVs with the time in their names")
    a.add_argument("--inclination", default="inclination", help="the CSV column")
    a.add_argument("--gauges", nargs="+", help="the CSV columns")
    a.add_argument("--reference", nargs=2, default=("2023-02-20", "2023-03-03"), metavar=("START", "END"))
    a.add_argument("--holdout-end", default="2023-03-09")
    a.add_argument("--event", default="2023-03-09 23:45:25")
    a.add_argument("--alpha", type=float, default=0.05)
    a.add_argument("--max-deviation", action="store_true", help="add the largest robust deviation as an arm")
    a.add_argument("--exclude-erratic", action="store_true", help="leave out gauges with heavy tails in the reference")
    a.add_argument("--json-out")
    args = a.parse_args(argv)
    if args.fetch and not (args.source and args.gauges):
        a.error("--fetch takes a --source and --gauges")
    spark = SparkSession.builder.getOrCreate()
    if args.fetch:
        samples = samples_of(spark, args.source, args.inclination, args.gauges)
        times = samples.select("file").distinct().select("file", event_time("file").alias("start_ts"))
        labelled_features(samples, times, tuple(args.reference), args.holdout_end, args.event).write.mode("overwrite").parquet(args.features)
    features = reports.found(spark, args.features, "make it with --fetch")
    if features is None:
        return reports.NO_DATA
    result = run_study(features, args.alpha, args.max_deviation, args.exclude_erratic)
    print(reports.markdown(result["states"].orderBy("label", "arm")))
    return reports.finish(result, args.json_out)


if __name__ == "__main__":
    raise SystemExit(main())
