"""Modes of multi-channel records: frequency responses, bands, singular-value spectra, shapes and tracking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mac, parabolic_offset
from ..functions.dense import hann_window, prominent_peaks
from ..functions.staged import bounded_batches
from . import spectral

SHAPE = "array<struct<re:double,im:double>>"
FRF_LENGTH, FRF_BAND, FRF_PROMINENCE, FRF_MODES, BAND_SHARE, BAND_HZ = 1024, (2.0, 25.0), 1.0, 8, 0.4, 0.5
FDD_LENGTH, FDD_BAND, FDD_PROMINENCE, FDD_MODES = 2048, (2.0, 14.0), 0.5, 5
MIN_MAC, SEARCH = 0.6, 0.2


def _cross_sums(samples: DataFrame, keys: list[str], values: Column, length: int, sampling_hz: float, band: tuple[float, float], detrend: bool, periodic: bool, channels: int = 0, first: bool = False) -> DataFrame:
    """``keys, n, bin, i, j, re, im, segments``: X_i conj(X_j) of channels i <= j (with ``first`` i = 0 only), summed over the half-overlapping segments of each record, for the bins inside a band.

    ``idx`` counts the samples of a record without gaps, from any number; short records are one segment. A segment with all its channels is a cell, and cells are
    what tasks work on, so one long record is spread over many; what a batch adds up for a record is what is shuffled. Without ``detrend`` the
    means of ``channels`` channels over the record go instead of each segment's own.
    """
    means = [] if detrend else [F.array(*[F.avg(F.get(values, F.lit(i))) for i in range(max(1, channels))]).alias("_mean")]
    counted = samples.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("idx").alias("_first"), *means)
    value = values if detrend else F.zip_with(values, "_mean", lambda x, m: x - m)
    long = samples.join(counted, keys).where(F.size(values) > 0).select(*keys, (F.col("idx") - F.col("_first")).alias("idx"), "_n", value.alias("value"))
    cells = spectral.gathered(spectral.half_overlapping(long, F.least(F.lit(length), F.col("_n"))), [*keys, "segment"])
    names, kinds = list(keys), [f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        import pyarrow as pa

        kept = [*names, "n", "low", "i", "j", "segments", "re", "im"]
        for batch in batches:
            x = batch.column(len(names))
            lengths, inner = x.value_lengths().to_numpy(zero_copy_only=False), x.flatten()
            wide = inner.value_lengths().to_numpy(zero_copy_only=False)
            if not len(wide):
                continue
            m = np.full((len(wide), wide.max()), np.nan)
            m[np.arange(wide.max()) < wide[:, None]] = inner.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            have = np.maximum.reduceat(wide, starts)  # channels of each segment
            number, record = {}, np.empty(len(x), np.int64)
            for at, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(len(names))))):
                record[at] = number.setdefault(key, at)  # the batch's first row of the record
            out = {k: [] for k in kept[len(names) :]}
            rows = []
            for n, p in sorted({*zip(lengths.tolist(), have.tolist())}):
                at = np.flatnonzero((lengths == n) & (have == p))
                at = at[np.argsort(record[at], kind="stable")]
                new = np.flatnonzero(np.diff(record[at], prepend=-1))
                freq = np.arange(n // 2 + 1) * sampling_hz / n
                inside = np.flatnonzero((freq >= band[0]) & (freq <= band[1]))
                if not len(inside):
                    continue
                part = m[starts[at][:, None] + np.arange(n)][:, :, :p]
                part = part - part.mean(axis=1, keepdims=True) if detrend else part
                spectra = np.fft.rfft(part * hann_window(int(n), periodic)[None, :, None], axis=1)[:, inside]
                for i in range(1 if first else p):
                    for j in range(i, p):
                        sums = np.add.reduceat(spectra[:, :, i] * np.conj(spectra[:, :, j]), new, axis=0)
                        rows.append(at[new])
                        for k, v in (("n", [n] * len(new)), ("low", [inside[0]] * len(new)), ("i", [i] * len(new)), ("j", [j] * len(new)), ("segments", np.diff(new, append=len(at))), ("re", sums.real), ("im", sums.imag)):
                            out[k].extend(v)
            if rows:
                kinds_of = {"n": pa.int64(), "low": pa.int32(), "i": pa.int32(), "j": pa.int32(), "segments": pa.int64(), "re": pa.list_(pa.float64()), "im": pa.list_(pa.float64())}
                named = [batch.column(i).take(pa.array(np.concatenate(rows))) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*named, *(pa.array(v, kinds_of[k]) for k, v in out.items())], kept)

    ordered = F.transform(F.array_sort("samples"), lambda s: s["value"])
    summed = bounded_batches(cells).select(*names, ordered.alias("x")).mapInArrow(run, ", ".join([*kinds, "n bigint, low int, i int, j int, segments bigint, re array<double>, im array<double>"]))
    bins = summed.select(*names, "n", "low", "i", "j", "segments", F.posexplode(F.arrays_zip("re", "im")).alias("place", "c"))
    return bins.groupBy(*names, "n", (F.col("low") + F.col("place")).alias("bin"), "i", "j").agg(F.sum("c.re").alias("re"), F.sum("c.im").alias("im"), F.sum("segments").alias("segments"))


def frf_indicator(samples: DataFrame, sampling_hz: float, length: int = FRF_LENGTH) -> DataFrame:
    """``recording, window, bin, freq_hz, power``: mean over the outputs of the squared H1 response to the excitation; null where that has no power.

    ``samples`` has ``recording, window, idx, excitation, responses array<double>``; cross and auto spectra are sums over segments, taken where the segments are transformed.
    """
    keys = ["recording", "window"]
    values = F.concat(F.array(F.col("excitation").cast("double")), F.col("responses").cast("array<double>"))
    sums = _cross_sums(samples, keys, values, length, sampling_hz, (0.0, float("inf")), True, True, first=True)
    auto, answer = F.max(F.when(F.col("j") == 0, F.col("re"))), F.avg(F.when(F.col("j") > 0, F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    mean = sums.groupBy(*keys, "n", "bin").agg(auto.alias("_auto"), answer.alias("_answer"), F.max("j").alias("_last")).where("_last > 0")
    mean = mean.withColumn("power", F.try_divide(F.col("_answer"), F.col("_auto") * F.col("_auto")))
    return mean.select("recording", F.col("window").cast("bigint").alias("window"), "bin", (F.col("bin") * sampling_hz / F.col("n")).alias("freq_hz"), "power")


def prominent(spectrum: DataFrame, keys: list[str], least: float, band: tuple[float, float], strongest: int) -> DataFrame:
    """``keys, bin, freq_hz, level``: the strongest prominent peaks of ``level`` inside a band, by frequency."""
    kinds = ", ".join(f"{k} {spectrum.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin")
        level = pdf["level"].to_numpy(float)
        at = prominent_peaks(level, least)
        at = np.sort(at[np.argsort(-level[at], kind="stable")[:strongest]])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in names}, "bin": pdf["bin"].to_numpy()[at], "freq_hz": pdf["freq_hz"].to_numpy()[at], "level": level[at]})

    inside = spectrum.where(F.col("freq_hz").between(*band)).select(*keys, F.col("bin").cast("int").alias("bin"), "freq_hz", "level")
    return inside.groupBy(*keys).applyInPandas(run, f"{kinds}, bin int, freq_hz double, level double")


def bands(found: DataFrame, keys: list[str], band: tuple[float, float] = FRF_BAND) -> DataFrame:
    """``keys, mode, lo, hi``: around each peak 0.4 of the distance to the nearest kept peak or band edge, half a hertz at most."""
    w = Window.partitionBy(*keys).orderBy("freq_hz")
    f = F.col("freq_hz")
    left, right = F.coalesce(F.lag(f).over(w), F.lit(band[0])), F.coalesce(F.lead(f).over(w), F.lit(band[1]))
    half = F.least(BAND_SHARE * F.least(f - left, right - f), F.lit(BAND_HZ))
    return found.select(*keys, (F.row_number().over(w) - 1).alias("mode"), (f - half).alias("lo"), (f + half).alias("hi"))


def band_peaks(spectrum: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """``keys, mode, freq_hz``: the highest bin of each band [lo, hi), moved to the vertex of the parabola through its neighbours."""
    w = Window.partitionBy(*keys).orderBy("bin")
    step = F.lead("freq_hz").over(w) - F.col("freq_hz")
    s = spectrum.withColumn("_l", F.lag("power").over(w)).withColumn("_r", F.lead("power").over(w)).withColumn("_step", F.coalesce(step, F.col("freq_hz") - F.lag("freq_hz").over(w)))
    inside = s.join(F.broadcast(of), (F.col("freq_hz") >= F.col("lo")) & (F.col("freq_hz") < F.col("hi")))
    top = inside.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "mode").orderBy(F.col("power").desc(), "bin"))).where("_k = 1")
    return top.select(*keys, "mode", (F.col("freq_hz") + F.col("_step") * parabolic_offset(F.col("_l"), F.col("power"), F.col("_r"))).alias("freq_hz"))


def fdd(samples: DataFrame, sampling_hz: float, length: int = FDD_LENGTH, band: tuple[float, float] = FDD_BAND) -> DataFrame:
    """``record, bin, freq_hz, s1, shape``: first singular value and vector of each record's cross-spectral matrix.

    ``samples`` has ``record, idx, channels array<double>``; the channels lose their mean over the record. Products of
    channels are averaged over segments; a task sees one bin's matrix. That of two channels is solved as a column.
    """
    channels = (samples.agg(F.max(F.size("channels"))).first()[0] or 0) if samples.columns else 0
    sums = _cross_sums(samples, ["record"], F.col("channels").cast("array<double>"), length, sampling_hz, band, False, False, channels)
    freq = (F.col("bin") * sampling_hz / F.col("n")).alias("freq_hz")
    cross = sums.select("record", "bin", freq, "i", "j", *[(F.col(c) / F.col("segments")).alias(c) for c in ("re", "im")])
    if channels == 2:
        pick = lambda i, j, c: F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col(c)))
        two = cross.groupBy("record", "bin", "freq_hz").agg(pick(0, 0, "re").alias("_a"), pick(1, 1, "re").alias("_d"), pick(0, 1, "re").alias("_re"), pick(0, 1, "im").alias("_im"))
        return two.select("record", "bin", "freq_hz", *hermitian_top(*[F.col(c) for c in ("_a", "_d", "_re", "_im")]))
    kind = samples.schema["record"].dataType.simpleString()
    whole = cross.groupBy("record", "bin", "freq_hz").agg(F.array_sort(F.collect_list(F.struct("i", "j", "re", "im"))).alias("m"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            tops, shapes = [], []
            for cells in pdf["m"]:
                p = max((c["j"] for c in cells), default=-1) + 1
                m = np.zeros((p, p), complex)
                for c in cells:
                    m[c["i"], c["j"]] = c["re"] + 1j * c["im"]
                values, vectors = np.linalg.eigh(np.triu(m) + np.conj(np.triu(m, 1)).T)
                tops.append(values[-1])
                shapes.append([{"re": float(c.real), "im": float(c.imag)} for c in vectors[:, -1]])
            yield pd.DataFrame({"record": pdf["record"], "bin": pdf["bin"], "freq_hz": pdf["freq_hz"], "s1": tops, "shape": shapes})

    return whole.mapInPandas(run, f"record {kind}, bin int, freq_hz double, s1 double, shape {SHAPE}")


def hermitian_top(a: Column, d: Column, re: Column, im: Column) -> list[Column]:
    """``s1, shape``: the larger eigenvalue of [[a, c], [conj c, d]] with c = re + i im, and its unit eigenvector."""
    gap, c2 = (a - d) / 2, re * re + im * im
    top = (a + d) / 2 + F.sqrt(gap * gap + c2)
    # the form without cancellation: the first place leads where a is the larger
    lead = F.when(a >= d, top - d).otherwise(top - a)
    norm = F.sqrt(lead * lead + c2)
    unit = lambda x, none: F.when(norm > 0, x / norm).otherwise(F.lit(none))
    pair = lambda x, y: F.struct(x.alias("re"), y.alias("im"))
    first = F.array(pair(unit(lead, 1.0), F.lit(0.0)), pair(unit(re, 0.0), unit(-im, 0.0)))
    second = F.array(pair(unit(re, 0.0), unit(im, 0.0)), pair(unit(lead, 1.0), F.lit(0.0)))
    return [top.alias("s1"), F.when(a >= d, first).otherwise(second).alias("shape")]


def reference_modes(spectra: DataFrame) -> DataFrame:
    """``mode, freq_hz, shape``: prominent peaks of the mean log spectrum; the shape is the dominant direction of the records' vectors there."""
    mean = spectra.groupBy("bin", "freq_hz").agg(F.avg(F.log("s1")).alias("level")).withColumn("_all", F.lit(0))
    found = prominent(mean, ["_all"], FDD_PROMINENCE, (float("-inf"), float("inf")), FDD_MODES)
    found = found.withColumn("mode", F.row_number().over(Window.partitionBy("_all").orderBy("freq_hz")) - 1).select("mode", "bin")
    at = spectra.join(F.broadcast(found), "bin")
    product = F.flatten(F.transform("shape", lambda a: F.transform(F.col("shape"), lambda b: F.struct((a["re"] * b["re"] + a["im"] * b["im"]).alias("re"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("im")))))
    outer = at.select("mode", "freq_hz", F.posexplode(product).alias("k", "c")).groupBy("mode", "freq_hz", "k").agg(F.sum("c.re").alias("re"), F.sum("c.im").alias("im"))

    @F.pandas_udf(SHAPE)
    def dominant(column):
        import pandas as pd

        out = []
        for flat in column:
            m = np.array([c["re"] + 1j * c["im"] for c in flat])
            p = int(round(len(m) ** 0.5))
            out.append([{"re": float(c.real), "im": float(c.imag)} for c in np.linalg.eigh(m.reshape(p, p))[1][:, -1]])
        return pd.Series(out)

    matrix = outer.groupBy("mode", "freq_hz").agg(F.array_sort(F.collect_list(F.struct("k", "re", "im"))).alias("m"))
    return matrix.select("mode", "freq_hz", dominant(F.transform("m", lambda c: F.struct(c["re"].alias("re"), c["im"].alias("im")))).alias("shape"))


def track_modes(spectra: DataFrame, modes: DataFrame, keys: list[str] = ("record",), min_mac: float = MIN_MAC, search: float = SEARCH) -> DataFrame:
    """``keys, mode, freq_hz, similarity``: per record and mode the strongest local maximum near the mode whose shape agrees.

    Candidates rise strictly from the left and don't rise to the right, within ``search`` of the mode's
    frequency. Without one that agrees the frequency is null and the similarity is the best found; without
    a candidate both are null.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("bin")
    s = spectra.withColumn("_l", F.lag("s1").over(w)).withColumn("_r", F.lead("s1").over(w)).withColumn("_step", F.lead("freq_hz").over(w) - F.col("freq_hz"))
    local = s.where((F.col("s1") > F.col("_l")) & (F.col("s1") >= F.col("_r")))
    m = modes.select("mode", F.col("freq_hz").alias("_f"), F.col("shape").alias("_shape"))
    found = local.join(F.broadcast(m), F.abs(F.col("freq_hz") - F.col("_f")) <= search * F.col("_f")).withColumn("similarity", mac("shape", "_shape"))
    good = F.col("similarity") >= min_mac
    place = F.col("freq_hz") + F.col("_step") * parabolic_offset(F.col("_l"), F.col("s1"), F.col("_r"))
    best = found.groupBy(*keys, "mode").agg(F.max(F.when(good, F.struct("s1", (-F.col("bin")).alias("b"), place.alias("f"), "similarity"))).alias("_m"), F.max("similarity").alias("_best"))
    best = best.select(*keys, "mode", F.col("_m.f").alias("freq_hz"), F.coalesce("_m.similarity", "_best").alias("similarity"))
    return spectra.select(*keys).distinct().crossJoin(F.broadcast(m.select("mode"))).join(best, [*keys, "mode"], "left")


def channel_rms(samples: DataFrame) -> DataFrame:
    """``record, channel, rms``: population deviation of each channel of each record."""
    return samples.select("record", F.posexplode("channels").alias("channel", "value")).groupBy("record", "channel").agg(F.stddev_pop("value").alias("rms"))


def tracked_share(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("mode").agg(F.avg(F.col("freq_hz").isNotNull().cast("int")).alias("tracked_share"))
