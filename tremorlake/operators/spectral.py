"""Spectra of single series: detrending, windows, periodograms, peaks, damping, modes, pairing and drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hann, severity, severity_rank
from ..functions.dense import hann_window
from ..functions.staged import bounded_batches

MIN_RATIO, MAX_MODES = 0.15, 3
MAX_SHIFT_HZ = 1.5


def windowed(signal: DataFrame) -> DataFrame:
    """``series, idx, n, x``: each series less its mean, under a symmetric Hann window."""
    w = Window.partitionBy("series")
    n = F.count("*").over(w)
    return signal.select("series", "idx", n.alias("n"), ((F.col("value") - F.avg("value").over(w)) * hann("idx", n)).alias("x"))


def periodogram_dft(signal: DataFrame, sampling_hz: float) -> DataFrame:
    """One-sided periodogram of short series by definition: every sample meets every bin of its series, then two sums."""
    x = windowed(signal.where("series is not null"))
    met = x.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") / 2).cast("int"))).alias("bin"))
    angle = 2 * F.pi() * F.col("bin") * F.col("idx") / F.col("n")
    sums = met.groupBy("series", "bin", "n").agg(F.sum(F.col("x") * F.cos(angle)).alias("_re"), F.sum(F.col("x") * F.sin(angle)).alias("_im"))
    return sums.select("series", "bin", (F.col("bin") * sampling_hz / F.col("n")).alias("freq_hz"), ((F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")) / F.col("n")).alias("power"))


def fourier(rows: DataFrame, keys: list[str], detrend: bool = True, periodic: bool = False) -> DataFrame:
    """``keys, n, re, im``: FFT of the ``samples`` (idx, value) of each row under a Hann window, as arrays over the bins; with ``detrend`` less their mean.

    Rows of one length are stacked, so an Arrow batch takes one FFT call a length. A row is one run of samples; it fits a cell.
    """
    names, kinds = list(keys), [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    ordered = F.transform(F.array_sort("samples"), lambda s: s["value"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(len(names))
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            out = np.empty(len(x), object)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                m = x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                m = m - m.mean(axis=1, keepdims=True) if detrend else m
                for i, row in zip(at, np.fft.rfft(m * hann_window(int(n), periodic), axis=1)):
                    out[i] = row
            offsets = pa.array(np.cumsum([0, *(len(p) for p in out)]).astype(np.int32))
            flat = np.concatenate(out) if len(out) else np.zeros(0, complex)
            parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(v))) for v in (flat.real, flat.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lengths.astype(np.int64)), *parts], [*names, "n", "re", "im"])

    return bounded_batches(rows).select(*names, ordered.alias("x")).mapInArrow(run, ", ".join([*kinds, "n bigint", "re array<double>", "im array<double>"]))


def bins(transforms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, bin, re, im``: one row per bin."""
    return transforms.select(*keys, "n", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c")).select(*keys, "n", "bin", "c.re", "c.im")


def half_overlapping(samples: DataFrame, length: Column) -> DataFrame:
    """``samples`` (idx, value, _n and others) with ``segment``: a sample goes to the two segments of ``length`` that hold it, those that end in time.

    ``idx`` counts from 0 without gaps; segments start every half length.
    """
    half = F.greatest(F.floor(length / 2), F.lit(1))
    last = F.floor(F.col("idx") / half)
    placed = samples.withColumn("segment", F.explode(F.array(last - 1, last)))
    return placed.where((F.col("segment") >= 0) & (F.col("idx") < F.col("segment") * half + length) & (F.col("segment") * half + length <= F.col("_n")))


def gathered(placed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, samples``: the samples of each segment in a cell."""
    return placed.groupBy(*keys).agg(F.collect_list(F.struct("idx", "value")).alias("samples"))


def periodogram(signal: DataFrame, sampling_hz: float) -> DataFrame:
    """The same by FFT; one series (a recording of one channel) is one cell of its samples."""
    spectrum = bins(fourier(gathered(signal, ["series"]), ["series"]), ["series"])
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    return spectrum.select("series", "bin", (F.col("bin") * sampling_hz / F.col("n")).alias("freq_hz"), power.alias("power"))


def averaged_psd(signal: DataFrame, sampling_hz: float) -> DataFrame:
    """Mean power of half-overlapping segments of a power of two; no rows for series too short for damping (under 288 samples).

    ``idx`` counts a series' samples without gaps, from any number. A sample goes to the two segments that hold it; segments are what
    tasks work on, so a long series is spread over as many tasks as it has segments, and its powers meet in a sum.
    """
    size = signal.groupBy("series").agg(F.count("*").alias("_n"), F.min("idx").alias("_first")).where(F.col("_n") / 4.5 >= 64)
    size = size.withColumn("_length", F.pow(F.lit(2.0), F.floor(F.log2(F.col("_n") / 4.5))).cast("bigint"))
    placed = half_overlapping(signal.join(size, "series").withColumn("idx", F.col("idx") - F.col("_first")), F.col("_length"))
    spectrum = bins(fourier(gathered(placed, ["series", "segment"]), ["series", "segment"]), ["series"])
    mean = spectrum.groupBy("series", "n", "bin").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    return mean.select("series", "bin", (F.col("bin") * sampling_hz / F.col("n")).alias("freq_hz"), "power")


def peaks(spectrum: DataFrame, ratio: float = MIN_RATIO) -> DataFrame:
    """Inner bins as high as both neighbours and as ``ratio`` times the highest bin; a plateau counts with every bin."""
    w = Window.partitionBy("series").orderBy("bin")
    top = F.max("power").over(Window.partitionBy("series"))
    out = spectrum.withColumn("_l", F.lag("power").over(w)).withColumn("_r", F.lead("power").over(w)).withColumn("_top", top)
    p = F.col("power")
    return out.where((F.col("_top") > 0) & (p >= ratio * F.col("_top")) & (p >= F.col("_l")) & (p >= F.col("_r"))).drop("_l", "_r", "_top")


def half_power_damping(psd: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``series, frequency_hz, damping_ratio``: half-power width over twice the peak frequency, 1 at most.

    The peak is the highest of the bin nearest to the frequency and its neighbours, the first and the last bin
    left out; the crossings are interpolated linearly. Null without both crossings or when they are under four bins apart.
    """
    near = psd.join(frequencies.select("series", "frequency_hz"), "series")
    w = Window.partitionBy("series", "frequency_hz").orderBy(F.abs(F.col("freq_hz") - F.col("frequency_hz")), "bin")
    centre = near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("series", "frequency_hz", F.col("bin").alias("_c"))
    ends = psd.groupBy("series").agg(F.min("bin").alias("_first"), F.max("bin").alias("_last"))
    inner = (F.col("bin") > F.col("_first")) & (F.col("bin") < F.col("_last"))
    around = near.join(centre, ["series", "frequency_hz"]).join(ends, "series").where((F.abs(F.col("bin") - F.col("_c")) <= 1) & inner)
    best = around.groupBy("series", "frequency_hz").agg(F.max(F.struct("power", (-F.col("bin")).alias("b"), "freq_hz")).alias("_m")).select("series", "frequency_hz", (-F.col("_m.b")).alias("_peak"), F.col("_m.power").alias("_top"), F.col("_m.freq_hz").alias("_f"))
    s = Window.partitionBy("series").orderBy("bin")
    steps = psd.withColumn("_next", F.lead("power").over(s)).withColumn("_width", F.lead("freq_hz").over(s) - F.col("freq_hz")).join(best, "series")
    half, p, q = F.col("_top") / 2, F.col("power"), F.col("_next")
    at = F.col("freq_hz") + F.col("_width") * (half - p) / (q - p)
    rising = (F.col("bin") < F.col("_peak")) & (p <= half) & (q > half)
    falling = (F.col("bin") >= F.col("_peak")) & (p > half) & (q <= half)
    out = steps.groupBy("series", "frequency_hz", "_f").agg(F.max_by(F.when(rising, at), F.when(rising, F.col("bin"))).alias("_lo"), F.min_by(F.when(falling, at), F.when(falling, F.col("bin"))).alias("_hi"), F.max("_width").alias("_width"))
    width = F.col("_hi") - F.col("_lo")
    return out.select("series", "frequency_hz", F.when(width >= 4 * F.col("_width"), F.least(F.lit(1.0), width / (2 * F.col("_f")))).alias("damping_ratio"))


def identify_modes(signal: DataFrame, sampling_hz: float, max_modes: int = MAX_MODES, ratio: float = MIN_RATIO) -> DataFrame:
    """``series, frequency_hz, damping_ratio, amplitude, confidence``: the strongest peaks, by frequency; none for fewer than 8 samples."""
    if sampling_hz <= 0:
        raise ValueError("the sampling frequency must be positive")
    long = signal.withColumn("_n", F.count("*").over(Window.partitionBy("series"))).where("_n >= 8").drop("_n")
    ranked = peaks(periodogram(long, sampling_hz), ratio).withColumn("_r", F.row_number().over(Window.partitionBy("series").orderBy(F.col("power").desc(), "bin"))).where(F.col("_r") <= max_modes)
    ranked = ranked.select("series", F.col("freq_hz").alias("frequency_hz"), F.col("power").alias("amplitude"), (F.col("power") / F.max("power").over(Window.partitionBy("series"))).alias("confidence"))
    damping = half_power_damping(averaged_psd(long, sampling_hz), ranked)
    return ranked.join(damping, ["series", "frequency_hz"], "left").select("series", *[F.round(c, 6).alias(c) for c in ("frequency_hz", "damping_ratio", "amplitude", "confidence")])


def dominant_frequency(modes: DataFrame) -> DataFrame:
    return modes.groupBy("series").agg(F.max_by("frequency_hz", "amplitude").alias("dominant_hz"))


def pair_modes(reference: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``ref_id, obs_id``, for each structure that ``keys`` name: each observation goes to its nearest reference by log frequency, each reference keeps its nearest observation.

    Ties go to the smaller id; an observation that loses is not given to another reference. Frequencies
    that aren't positive and finite pair with nothing.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    pairs = observed.where(good("obs_hz")).join(reference.where(good("ref_hz")), list(keys) or None).withColumn("_d", F.abs(F.log(F.col("obs_hz") / F.col("ref_hz"))))
    mine = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "obs_id").orderBy("_d", "ref_id"))).where("_r = 1")
    return mine.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "ref_id").orderBy("_d", "obs_id"))).where("_r = 1").drop("_r", "_d")


def baseline_drift(reference: DataFrame, observed: DataFrame, resolution_hz: float, warn: float = 5.0, alarm: float = 10.0, max_shift_hz: float = MAX_SHIFT_HZ, keys: Sequence[str] = ()) -> DataFrame:
    """Each reference mode with its observation, the drop in percent, and a severity.

    Without an observation within ``max_shift_hz`` a mode is to be watched; a shift within the spectral
    resolution says nothing.
    """
    paired = reference.join(pair_modes(reference, observed, keys).select(*keys, "ref_id", "obs_hz"), [*keys, "ref_id"], "left")
    near = F.col("obs_hz").isNotNull() & (F.abs(F.col("obs_hz") - F.col("ref_hz")) <= max_shift_hz)
    limited = near & (F.abs(F.col("obs_hz") - F.col("ref_hz")) <= resolution_hz)
    drop = 100 * (F.col("ref_hz") - F.col("obs_hz")) / F.col("ref_hz")
    return paired.select(
        *keys,
        "ref_id",
        "ref_hz",
        F.when(near, F.col("obs_hz")).alias("obs_hz"),
        F.when(near, drop).alias("drop_percent"),
        F.coalesce(limited, F.lit(False)).alias("resolution_limited"),
        F.when(~near, "watch").when(limited, "none").otherwise(severity(drop, warn, alarm)).alias("severity"),
    )


def overall_drift(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (for each structure that ``keys`` name): the worst severity and the largest drop that isn't limited by the resolution."""
    return findings.groupBy(*keys).agg(
        F.coalesce(F.max_by("severity", severity_rank("severity")), F.lit("none")).alias("severity"),
        F.max(F.when(~F.col("resolution_limited"), F.col("drop_percent"))).alias("max_drop_percent"),
    )
