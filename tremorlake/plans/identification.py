"""Modes of the series in a CSV file, their drift from a baseline and from a shear model, as JSON.

python -m tremorlake.plans.identification --input-csv record.csv --column value --sampling-hz 100
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dense import shear_frequencies
from ..operators import modal, physical, spectral
from ..sources.vibration import read_vibration


def identify(signal: DataFrame, sampling_hz: float, max_modes: int = spectral.MAX_MODES, ratio: float = spectral.MIN_RATIO) -> DataFrame:
    """Modes of one series by its spectrum, of several by their common cross-spectra (then without damping)."""
    names = [r[0] for r in signal.select("series").distinct().orderBy("series").collect()]
    if len(names) == 1:
        return spectral.identify_modes(signal, sampling_hz, max_modes, ratio)
    wide = signal.groupBy("idx").pivot("series", names).agg(F.first("value")).dropna()
    samples = wide.select(F.lit(0).alias("record"), "idx", F.array(*names).alias("channels"))
    found = modal.fdd(samples, sampling_hz, band=(0.0, sampling_hz / 2))
    power = found.select(F.lit(",".join(names)).alias("series"), "bin", "freq_hz", F.col("s1").alias("power"))
    ranked = spectral.peaks(power, ratio).orderBy(F.col("power").desc()).limit(max_modes)
    top = ranked.agg(F.max("power").alias("_top"))
    return ranked.crossJoin(F.broadcast(top)).select("series", F.round("freq_hz", 6).alias("frequency_hz"), F.lit(None).cast("double").alias("damping_ratio"), F.round("power", 6).alias("amplitude"), F.round(F.col("power") / F.col("_top"), 6).alias("confidence"))


def report(spark: SparkSession, args) -> dict:
    columns = args.columns.split(",") if args.columns else [args.column]
    signal = read_vibration(spark, args.input_csv, columns)
    modes = identify(signal, args.sampling_hz, args.max_modes, args.min_prominence_ratio).orderBy("frequency_hz").collect()
    n = signal.select("idx").distinct().count()
    out = {"modes": [r.asDict() for r in modes], "samples": n, "sampling_hz": args.sampling_hz, "resolution_hz": args.sampling_hz / n if n >= 8 else 0.0}
    observed = spark.createDataFrame([(i, float(r["frequency_hz"])) for i, r in enumerate(modes)], "obs_id int, obs_hz double")
    table = lambda values: spark.createDataFrame(list(enumerate(map(float, values))), "ref_id int, ref_hz double")
    if args.baseline_frequencies_hz:
        findings = spectral.baseline_drift(table(args.baseline_frequencies_hz), observed, out["resolution_hz"], args.warn_pct, args.alarm_pct)
        out["drift"] = {"findings": [r.asDict() for r in findings.orderBy("ref_id").collect()], **spectral.overall_drift(findings).first().asDict()}
    if args.fe_story_masses_kg:
        model = table(shear_frequencies(args.fe_story_masses_kg, args.fe_story_stiffness_n_per_m))
        out["model"] = physical.model_consistency(model, observed).first().asDict()
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input-csv", required=True)
    p.add_argument("--column", default="value")
    p.add_argument("--columns", help="comma-separated; two or more")
    p.add_argument("--sampling-hz", type=float, required=True)
    p.add_argument("--max-modes", type=int, default=spectral.MAX_MODES)
    p.add_argument("--min-prominence-ratio", type=float, default=spectral.MIN_RATIO)
    p.add_argument("--baseline-frequencies-hz", type=float, nargs="+")
    p.add_argument("--fe-story-masses-kg", type=float, nargs="+")
    p.add_argument("--fe-story-stiffness-n-per-m", type=float, nargs="+")
    p.add_argument("--warn-pct", type=float, default=5.0)
    p.add_argument("--alarm-pct", type=float, default=10.0)
    p.add_argument("--output-path")
    args = p.parse_args(argv)
    if args.columns and len(args.columns.split(",")) < 2:
        p.error("--columns takes two or more; --column takes one")
    if bool(args.fe_story_masses_kg) != bool(args.fe_story_stiffness_n_per_m) or len(args.fe_story_masses_kg or []) != len(args.fe_story_stiffness_n_per_m or []):
        p.error("give as many masses as stiffnesses")
    text = json.dumps(report(SparkSession.builder.getOrCreate(), args), indent=2)
    if args.output_path:
        with open(args.output_path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
