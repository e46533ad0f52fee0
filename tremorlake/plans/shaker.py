"""Shaker recordings: windows, frequency responses, modal frequencies per window, labelled states.

python -m tremorlake.plans.shaker --fetch --source "recordings/*.npz" --cache samples --reference 0922 --holdout 0927
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staged import written
from ..operators import modal, segments, statistics
from ..sources import hdf5, recordings
from . import reports
from .states import evaluate_states

WINDOW_S, TRIM_S = 60, 5


def window_frequencies(samples: DataFrame, sampling_hz: float, reference: str) -> tuple[DataFrame, DataFrame]:
    """``recording, window, m0, m1, ...`` of steady windows, and the mode bands found in the reference recording.

    ``samples`` has ``recording, idx, excitation, responses array<double>``.
    """
    cut = segments.tumbling(samples, ["recording"], int(WINDOW_S * sampling_hz), int(TRIM_S * sampling_hz))
    steady = segments.steady_windows(cut, ["recording"], "excitation").select("recording", "window")
    spectra = written(modal.frf_indicator(cut.join(steady, ["recording", "window"], "left_semi"), sampling_hz))
    mean = spectra.where(F.col("recording") == reference).groupBy("bin", "freq_hz").agg(F.log(F.avg("power")).alias("level")).withColumn("all", F.lit(0))
    bands = modal.bands(modal.prominent(mean, ["all"], modal.FRF_PROMINENCE, modal.FRF_BAND, modal.FRF_MODES), ["all"])
    modes = [r[0] for r in bands.select("mode").orderBy("mode").collect()]  # eight at most
    peaks = modal.band_peaks(spectra, ["recording", "window"], bands.drop("all"))
    wide = peaks.groupBy("recording", "window").pivot("mode", modes).agg(F.first("freq_hz"))
    return wide.select("recording", "window", *[F.col(str(m)).alias(f"m{m}") for m in modes]), bands


def run_study(samples: DataFrame, sampling_hz: float, labels: DataFrame, reference: str, alpha: float = 0.1) -> dict[str, DataFrame]:
    """``labels(recording, label)`` names each recording's state; the reference recording's label is ``reference``."""
    wide, bands = map(written, window_frequencies(samples, sampling_hz, reference))
    features = [c for c in wide.columns if c.startswith("m")]
    rows = wide.dropna().join(F.broadcast(labels), "recording").withColumn("rid", F.concat_ws("/", "recording", "window"))
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])).alias("v")).select("label", "v.*")
    return {"bands": bands, "frequencies": wide, "states": evaluate_states(rows, "rid", features, alpha), "shifts": statistics.shifts_over_sigma(long)}


def samples_of(arrays: DataFrame, excitation: str = "excitation") -> DataFrame:
    """``recording, idx, excitation, responses`` from ``recording, sensor, samples``: the sensors side by side, by name, cut to the shortest."""
    sensors = F.filter("_s", lambda s: s["sensor"] != excitation)
    lists = arrays.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("sensor", "samples"))).alias("_s"))
    lists = lists.select("recording", F.get(F.filter("_s", lambda s: s["sensor"] == excitation), F.lit(0))["samples"].alias("_x"), F.transform(sensors, lambda s: s["samples"]).alias("_y"))
    steps = F.slice("_x", F.lit(1), F.least(F.size("_x"), F.array_min(F.transform("_y", F.size))))
    turned = F.transform(steps, lambda x, i: F.struct(x.alias("excitation"), F.transform("_y", lambda y: F.get(y, i)).alias("responses")))
    return lists.select("recording", F.posexplode(turned).alias("idx", "_at")).select("recording", F.col("idx").cast("bigint").alias("idx"), "_at.*")


def samples_of_ranges(rows: DataFrame, excitation: str) -> DataFrame:
    """The same from ``recording, sensor, start, samples``: ranges of samples, met by place, so a long recording is spread over tasks."""
    long = rows.select("recording", "sensor", "start", F.posexplode("samples").alias("_p", "value")).withColumn("idx", F.col("start") + F.col("_p"))
    drives = F.col("sensor") == excitation
    at = long.groupBy("recording", "idx").agg(
        F.count("*").alias("_have"), F.max(F.when(drives, F.col("value"))).alias("excitation"), F.array_sort(F.collect_list(F.when(~drives, F.struct("sensor", "value")))).alias("_y")
    )
    sensors = rows.groupBy("recording").agg(F.countDistinct("sensor").alias("_all"))  # a row a recording
    whole = at.join(sensors, "recording").where(F.col("_have") == F.col("_all"))  # up to the shortest sensor's end
    return whole.select("recording", "idx", "excitation", F.transform("_y", lambda y: y["value"]).alias("responses"))


def read_shaker_subset(spark: SparkSession, path: str, recordings: list[str], excitation: str, responses: list[str], group: str = "acceleration") -> DataFrame:
    """Samples from an HDF5 file whose datasets are ``recording/group/sensor``; only the named sensors of the named recordings are read."""
    names = [f"{r}/{group}/{s}" for r in recordings for s in (excitation, *responses)]
    rows = hdf5.read_subset(spark, [path], names).withColumn("recording", F.substring_index("dataset", "/", 1))
    sensor = F.expr(f"substring(dataset, length(recording) + {len(group) + 3})")
    return samples_of_ranges(rows.select("recording", sensor.alias("sensor"), "start", "samples"), excitation)


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--cache", required=True, help="Parquet with recording, idx, excitation, responses")
    a.add_argument("--fetch", action="store_true", help="make the cache from --source first")
    a.add_argument("--source", help="NPZ recordings with an array named excitation and one per response, or one HDF5 file (.h5, .hdf5)")
    a.add_argument("--recordings", nargs="*", default=[], help="recordings to read from an HDF5 file, the two undamaged ones included")
    a.add_argument("--excitation", default="AS/z", help="its dataset in an HDF5 recording's acceleration group")
    a.add_argument("--responses", nargs="*", default=[f"AG{i:02d}/z" for i in range(1, 19)], help="the responses' datasets there")
    a.add_argument("--sampling-hz", type=float, default=100.0)
    a.add_argument("--reference", required=True, help="the undamaged recording to learn from")
    a.add_argument("--holdout", required=True, help="the other undamaged recording; all others keep their names as labels")
    a.add_argument("--same-session-reference", action="store_true", help="swap the two undamaged recordings")
    a.add_argument("--alpha", type=float, default=0.1)
    a.add_argument("--json-out")
    args = a.parse_args(argv)
    if args.fetch and not args.source:
        a.error("--fetch takes a --source")
    spark = SparkSession.builder.getOrCreate()
    if args.fetch:
        if args.source.endswith((".h5", ".hdf5")):
            wanted = list(dict.fromkeys([args.reference, args.holdout, *args.recordings]))
            made = read_shaker_subset(spark, args.source, wanted, args.excitation, args.responses)
        else:
            made = samples_of(recordings.read_npz(spark, args.source))
        made.write.mode("overwrite").parquet(args.cache)
    samples = reports.found(spark, args.cache, "make it with --fetch")
    if samples is None:
        return reports.NO_DATA
    reference, holdout = (args.holdout, args.reference) if args.same_session_reference else (args.reference, args.holdout)
    name = F.when(F.col("recording") == reference, "reference").when(F.col("recording") == holdout, "holdout").otherwise(F.col("recording"))
    labels = samples.select("recording", name.alias("label")).distinct()
    result = run_study(samples, args.sampling_hz, labels, reference, args.alpha)
    print(reports.markdown(result["states"].orderBy("label", "arm")))
    return reports.finish(result, args.json_out)


if __name__ == "__main__":
    raise SystemExit(main())
