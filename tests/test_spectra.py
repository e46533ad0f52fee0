"""Spectra, modes, events, models, sources and streams."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake.functions import columns, dense
from tremorlake.operators import events, modal, physical, spectral
from tremorlake.plans import identification
from tremorlake.sources import damaged_zip, texts
from tremorlake.sources.vibration import read_vibration


def signal(spark, x, name="s"):
    return spark.createDataFrame(pd.DataFrame({"series": name, "idx": range(len(x)), "value": x}))


def test_identifies_frequencies_and_damping(spark):
    t = np.arange(3000) / 50
    x = np.sin(2 * np.pi * 2 * t) + 0.6 * np.sin(2 * np.pi * 7.3 * t)
    got = spectral.identify_modes(signal(spark, x), 50.0).orderBy("frequency_hz").toPandas()
    assert np.abs(got["frequency_hz"].to_numpy()[[0, -1]] - [2.0, 7.3]).max() < 0.05
    assert spectral.identify_modes(signal(spark, x[:5]), 50.0).count() == 0
    with pytest.raises(ValueError):
        spectral.identify_modes(signal(spark, x), 0.0)
    fft, dft = (f(signal(spark, x[:256]), 50.0).orderBy("bin").toPandas()["power"].to_numpy() for f in (spectral.periodogram, spectral.periodogram_dft))
    assert np.allclose(fft, dft)


def test_segments_of_a_long_series_are_spread_over_tasks(spark):
    rng = np.random.default_rng(4)
    x, short = rng.normal(size=5000), rng.normal(size=300)
    both = signal(spark, x).unionByName(signal(spark, short, "t")).unionByName(signal(spark, short[:200], "u"))
    got = spectral.averaged_psd(both, 50.0).toPandas()
    assert set(got["series"]) == {"s", "t"}
    for name, values, length in (("s", x, 1024), ("t", short, 64)):
        part = got[got["series"] == name].sort_values("bin")
        want = (np.abs(dense.segment_spectra(values[:, None], length, dense.hann_window(length), True)[:, :, 0]) ** 2).mean(axis=0)
        assert np.allclose(part["power"], want) and np.allclose(part["freq_hz"], np.arange(length // 2 + 1) * 50.0 / length)
    plan = spectral.averaged_psd(both, 50.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_series_of_many_lengths_share_batches(spark):
    rng = np.random.default_rng(5)
    series = {i: rng.normal(size=1 + i % 9) for i in range(60)}
    rows = [(i, k, float(v)) for i, x in series.items() for k, v in enumerate(x)]
    got = spectral.periodogram(spark.createDataFrame(rows, "series int, idx int, value double"), 10.0).toPandas()
    for i, x in series.items():
        want = np.abs(np.fft.rfft((x - x.mean()) * dense.hann_window(len(x)))) ** 2 / len(x)
        assert np.allclose(got[got["series"] == i].sort_values("bin")["power"], want)
    empty = spark.createDataFrame([], "series int, idx int, value double")
    assert spectral.periodogram(empty, 10.0).count() == spectral.averaged_psd(empty, 10.0).count() == 0


def test_damping_of_a_noise_driven_oscillator(spark):
    rng = np.random.default_rng(12345)
    w, z, step = 2 * np.pi * 2, 0.02, 1 / 500
    x, v, out = 0.0, 0.0, []
    for i, f in enumerate(rng.normal(size=300000)):
        v += step * (-2 * z * w * v - w * w * x) + np.sqrt(step) * f
        x += step * v
        if i % 10 == 0:
            out.append(x)
    got = spectral.identify_modes(signal(spark, np.array(out)), 50.0, max_modes=1).first()
    assert abs(got["frequency_hz"] - 2) < 0.1
    psd = spectral.averaged_psd(signal(spark, np.array(out)), 50.0)
    damping = spectral.half_power_damping(psd, spark.createDataFrame([("s", 2.0)], "series string, frequency_hz double")).first()
    assert 0.01 <= damping["damping_ratio"] <= 0.04


def pairs(spark, ref, obs):
    return spark.createDataFrame(list(enumerate(ref)), "ref_id int, ref_hz double"), spark.createDataFrame(list(enumerate(obs)), "obs_id int, obs_hz double")


def test_pairing_and_drift(spark):
    r, o = pairs(spark, [3.0, 4.2], [3.0, 3.1])
    assert [tuple(x) for x in spectral.pair_modes(r, o).select("ref_id", "obs_id").collect()] == [(0, 0)]
    findings = spectral.baseline_drift(*pairs(spark, [5.0], [4.4]), 0.01)
    assert findings.first()["severity"] == "alarm" and spectral.overall_drift(findings).first()["max_drop_percent"] == pytest.approx(12)
    assert spectral.baseline_drift(*pairs(spark, [50.0], [3.0]), 0.01).first()["severity"] == "watch"
    limited = spectral.baseline_drift(*pairs(spark, [3.0], [2.995]), 0.01).first()
    assert limited["severity"] == "none" and limited["resolution_limited"]


def test_prominence_and_parabola(spark):
    f = np.arange(0, 10, 0.1)
    y = np.exp(-0.5 * ((f - 5.03) / 0.3) ** 2)
    s = spark.createDataFrame(pd.DataFrame({"k": 0, "bin": range(100), "freq_hz": f, "power": y, "level": np.log(y + 1e-300)}))
    at = modal.band_peaks(s, ["k"], spark.createDataFrame([(0, 4.0, 6.0)], "mode int, lo double, hi double")).first()
    assert abs(at["freq_hz"] - 5.03) < 1e-6
    assert dense.prominent_peaks(np.array([0, 2, 1, 3, 3, 0, 1, 0.5]), 1.0).tolist() == [1, 3]
    found = modal.prominent(s, ["k"], 1.0, (2.0, 8.0), 3)
    band = modal.bands(found, ["k"], (2.0, 8.0)).first()
    assert band["hi"] - band["lo"] == pytest.approx(1.0)


def test_fdd_and_tracking(spark):
    rng = np.random.default_rng(0)
    shape = np.array([1, 0.5 + 0.3j, -0.4])
    frames = []
    for record, f in enumerate((4.0, 4.1, 4.2)):
        t = np.arange(8192) / 100
        x = np.real(np.outer(np.exp(2j * np.pi * f * t), shape)) + np.outer(np.sin(2 * np.pi * 9 * t), [0.3, 0.2, 0.5]) + 0.05 * rng.normal(size=(8192, 3))
        frames.append(pd.DataFrame({"record": record, "idx": range(8192), "channels": x.tolist()}))
    spectra = modal.fdd(spark.createDataFrame(pd.concat(frames)), 100.0).cache()
    modes = modal.reference_modes(spectra.where("record = 0")).cache()
    first = modes.orderBy("freq_hz").first()
    assert abs(first["freq_hz"] - 4.0) < 0.1
    got = np.array([c["re"] + 1j * c["im"] for c in first["shape"]])
    assert abs(np.vdot(got, shape)) ** 2 / (np.vdot(got, got) * np.vdot(shape, shape)).real > 0.99
    tracked = modal.track_modes(spectra, modes.orderBy("freq_hz").limit(1)).orderBy("record").toPandas()
    assert np.abs(tracked["freq_hz"] - [4.0, 4.1, 4.2]).max() < 0.03 and tracked["similarity"].min() > 0.99
    assert modal.tracked_share(modal.track_modes(spectra, modes)).where("mode = 0").first()["tracked_share"] == 1


def test_cross_spectra_of_two_channels_agree_with_a_decomposition(spark):
    rng = np.random.default_rng(8)
    rows, x = [], {}
    for record, n in ((0, 1000), (1, 130), (2, 40)):
        x[record] = rng.normal(size=(n, 2)) @ np.array([[1.0, 0.4 * record], [0.0, 1.5 - record]])
        rows += [(record, i, v.tolist()) for i, v in enumerate(x[record])]
    table = spark.createDataFrame(rows, "record int, idx int, channels array<double>")
    got = modal.fdd(table, 100.0, 128, (0.0, 50.0)).toPandas()
    plan = modal.fdd(table, 100.0, 128)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" not in plan
    for record, v in x.items():
        n = min(128, len(v))
        s = dense.segment_spectra(v - v.mean(0), n, dense.hann_window(n), False)
        u, sv, _ = np.linalg.svd(np.einsum("sbi,sbj->bij", s, np.conj(s)) / len(s))
        part = got[got["record"] == record].sort_values("bin")
        assert np.allclose(part["s1"], sv[:, 0])
        shape = np.array([[c["re"] + 1j * c["im"] for c in row] for row in part["shape"]])
        sure = sv[:, 0] > 1.001 * sv[:, 1]
        assert np.allclose(np.abs((np.conj(shape) * u[:, :, 0]).sum(1))[sure], 1)
    flat = spark.createDataFrame([(0, i, [1.0, 2.0]) for i in range(9)], "record int, idx int, channels array<double>")
    assert {r["s1"] for r in modal.fdd(flat, 100.0, 8, (0.0, 50.0)).collect()} == {0.0}


def test_frequency_response(spark):
    rng = np.random.default_rng(0)
    n = 6000
    u, dt_, w, z = rng.normal(size=n), 0.01, 2 * np.pi * 4, 0.02
    x, v, y = 0.0, 0.0, []
    for f in u:
        v += dt_ * (f - 2 * z * w * v - w * w * x)
        x += dt_ * v
        y.append(v)
    pdf = pd.DataFrame({"recording": "a", "window": 0, "idx": range(n), "excitation": u, "responses": [[float(a), float(2 * a)] for a in y]})
    got = modal.frf_indicator(spark.createDataFrame(pdf), 100.0).toPandas()
    assert abs(got.loc[got["power"].idxmax(), "freq_hz"] - 4.0) < 0.2


def test_openings(spark):
    n = 8000
    inc = np.r_[np.full(2500, -1.1), np.linspace(-1.1, -74, 3000), np.linspace(-74, -1.1, 2500)]
    frames = [pd.DataFrame({"file": f, "idx": range(n), "inclination": np.maximum(inc, low), "channel": c, "value": k * inc}) for f, low in (("full", -99), ("part", -45)) for c, k in (("g1", 10.0), ("g2", 0.0), ("g3", -2.0))]
    samples = spark.createDataFrame(pd.concat(frames))
    got = {(r["file"], r["angle"], r["channel"]): r["feature"] for r in events.opening_features(samples).collect()}
    assert {k[0] for k in got} == {"full"} and got["full", -60.0, "g2"] == 0
    assert got["full", -30.0, "g1"] == pytest.approx(-289, abs=1) and got["full", -60.0, "g3"] == pytest.approx(117.8, abs=0.5)
    assert len(events.feature_order(events.opening_features(samples)).first()["features"]) == 6


def test_shear_models(spark):
    one, two = dense.shear_frequencies([2.0], [800.0]), dense.shear_frequencies([1.0, 1.0], [100.0, 100.0])
    assert one[0] == pytest.approx(20 / (2 * np.pi)) and two[0] == pytest.approx(np.sqrt((3 - 5**0.5) / 2 * 100) / (2 * np.pi))
    models = spark.createDataFrame([([1.0, 2.0, 1.5], [50.0, 60.0, 70.0])], "masses array<double>, stiffness array<double>")
    matrix = np.array(physical.stiffness_matrix(models).first()["matrix"])
    assert (matrix == [[110, -60, 0], [-60, 130, -70], [0, -70, 70]]).all()
    assert len(physical.natural_frequencies(models).first()["frequencies_hz"]) == 3
    r = physical.model_consistency(*pairs(spark, [1.0, 2.0], [0.9, 1.8])).first()
    assert r["stiffness_ratio"] == pytest.approx(0.81) and r["spread_percent"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        dense.shear_frequencies([1.0], [0.0])


def test_csv_source_and_report(spark, tmp_path, capsys):
    path = tmp_path / "v.csv"
    t = np.arange(1200) / 20
    path.write_text("a,value\n" + "".join(f"{i},{x}\n" for i, x in enumerate(np.sin(2 * np.pi * 1.8 * t))))
    assert read_vibration(spark, str(path), ["value"]).count() == 1200
    args = ["--input-csv", str(path), "--sampling-hz", "20", "--baseline-frequencies-hz", "2.1", "--fe-story-masses-kg", "1", "--fe-story-stiffness-n-per-m", "130"]
    assert identification.main(args) == 0
    out = json.loads(capsys.readouterr().out)
    assert abs(out["modes"][0]["frequency_hz"] - 1.8) < 0.02 and out["drift"]["severity"] == "alarm" and out["model"]["paired"] == 1
    for text, columns in (("a,b\n1,2\n", ["c"]), ("a,b\n1,2\n", []), ("a,b\n1,\n", ["b"]), ("a,b\n1,x\n", ["b"]), ("a,b\n1,inf\n", ["b"]), ("a,b\n", ["a"])):
        path.write_text(text)
        with pytest.raises(ValueError):
            read_vibration(spark, str(path), columns)


def test_damaged_zip(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        for i in range(3):
            z.writestr(f"r{i}", bytes([i]) * 500)
    raw = inner.getvalue()
    cut = raw.index(b"\x01" * 500) + 100
    path = tmp_path / "d.zip"
    path.write_bytes(raw[:cut] + raw[cut + 37 :])
    rows = {r["name"]: r for r in damaged_zip.read_records(spark, str(path), []).collect()}
    assert [rows[f"r{i}"]["crc_ok"] for i in range(3)] == [True, False, True] and rows["r1"]["payload"] is None
    whole = tmp_path / "w.zip"
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("box.zip", raw)
    assert damaged_zip.read_records(spark, str(whole), ["box.zip"]).where("crc_ok").count() == 3
    # two losses in different members of an inner archive, and members behind it
    cuts = [raw.index(bytes([i]) * 500) + 50 for i in (0, 1)]
    short = raw[: cuts[0]] + raw[cuts[0] + 20 : cuts[1]] + raw[cuts[1] + 30 :]
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("first.txt", "x" * 100)
        z.writestr("box.zip", raw)
        z.writestr("other.zip", raw)
    lossy = whole.read_bytes().replace(raw, short, 1)
    (tmp_path / "l.zip").write_bytes(lossy)
    got = [(r["name"], r["crc_ok"]) for r in damaged_zip.read_records(spark, str(tmp_path / "l.zip"), ["box.zip", "other.zip"]).collect()]
    assert sorted(got) == sorted([("r0", False), ("r1", False), ("r2", True), ("r0", True), ("r1", True), ("r2", True)])
    with pytest.raises(Exception, match="no member"):
        damaged_zip.read_records(spark, str(whole), ["none.zip"]).collect()


def test_texts(spark, tmp_path):
    env = "T1 [C] T2 [C] V [V] T1 [C]\n4.0 15 1.0 9\n4.8 16 3.0 9\nscan done at noon\n"
    acc = "head\n3\nunits\n1.5\n2.5\n3.5\n9\n"
    files = spark.createDataFrame([("01C14", "01C14PRE.ENV", env), ("01C14", "01c14a.aaa", acc), ("01C14", "01c14b.aaa", acc.replace("3\n", "2\n", 1))], "name string, file string, content string")
    got = {r["label"]: r["value"] for r in texts.environment(files, {"V": (10.0, 1.0)}).collect()}
    assert got == {"T1": 4.4, "T2": 15.5, "V": 21.0}
    assert [list(r["channels"]) for r in texts.accelerations(files, ["a", "b"]).orderBy("idx").collect()] == [[1.5, 1.5], [2.5, 2.5]]
    assert texts.accelerations(files, ["a", "c"]).count() == 0
    readings = spark.createDataFrame([("r", "a", 7.0), ("r", "b", 7.2), ("r", "c", 3276.7)], "name string, label string, value double")
    assert texts.plausible_median(readings, ["a", "b", "c"]).first()["value"] == pytest.approx(7.1)
    names = spark.createDataFrame([("01C14", 737334.0 + 23 / 24)], "n string, d double").select(columns.record_time("n", "2000-01-01").cast("string"), columns.datenum_time("d").cast("string"), columns.event_time(F.lit("x/2023_03_09T23_45_25.csv")).cast("string")).first()
    assert tuple(names) == ("2000-01-03 14:00:00", "2018-10-01 23:00:00", "2023-03-09 23:45:25")
    with pytest.raises(FileNotFoundError):
        texts.load_config(str(tmp_path / "none.json"))


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "f.bin").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "f.bin"))
    good = spark.createDataFrame([("f.bin", hashlib.md5(b"abc").hexdigest())], "name string, digest string")
    assert texts.verified(files, good).first()["content"] == b"abc"
    with pytest.raises(Exception, match="checksum"):
        texts.verified(files, good.withColumn("digest", F.lit("0"))).collect()


def test_streams(spark, tmp_path):
    from tremorlake.streaming.cusum import stream_cusum

    days = spark.createDataFrame([("s", "a", f"2020-01-{d:02d}", 1 / 131) for d in range(1, 5)], "structure string, arm string, day string, p_value double").withColumn("day", F.to_date("day"))
    days.write.parquet(str(tmp_path / "in"))
    q = stream_cusum(spark.readStream.schema(days.schema).parquet(str(tmp_path / "in")), 5.0).writeStream.format("memory").queryName("levels").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["alarmed"] for r in spark.table("levels").orderBy("day").collect()] == [False, True, True, True]


def test_a_shuffled_stream_gives_the_levels_of_the_sorted_record(spark, tmp_path):
    import datetime as dt

    from tremorlake.operators import calibration
    from tremorlake.streaming.cusum import stream_cusum

    rng = np.random.default_rng(6)
    schema, rows = "structure string, arm string, day date, p_value double", []
    for s in ("x", "y"):
        rows += [(s, "a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(rng.uniform(0.01, 1, 30))]
    # each day comes up to five days out of place; the last file's far day moves the watermark past all others
    shuffled = sorted(rows, key=lambda r: (r[2].toordinal() + rng.integers(0, 5), r[0]))
    flush = [(s, "a", dt.date(2020, 6, 1), 0.5) for s in ("x", "y")]
    for k, part in enumerate([*(shuffled[i : i + 12] for i in range(0, 60, 12)), flush]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not k:
            stream = stream_cusum(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5.0, lateness="8 days")
            q = stream.writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
    q.stop()
    got = {(r["structure"], r["day"]): (r["level"], r["alarmed"]) for r in spark.table("ordered").collect()}
    want = calibration.cusum_path(spark.createDataFrame(rows, schema), ["structure", "arm"]).collect()
    assert got.keys() == {(r["structure"], r["day"]) for r in want}
    assert all(abs(got[r["structure"], r["day"]][0] - r["level"]) < 1e-9 and got[r["structure"], r["day"]][1] == (r["level"] >= 5.0) for r in want)


def test_recordings_and_manifest(spark, tmp_path):
    from tremorlake.sources import recordings

    np.savez(tmp_path / "r1.npz", force=np.arange(50.0), plate=np.arange(20.0).reshape(10, 2))
    got = recordings.read_npz(spark, str(tmp_path / "r1.npz")).cache()
    assert {(r["sensor"], len(r["samples"])) for r in got.collect()} == {("force", 50), ("plate_0", 10), ("plate_1", 10)}
    manifest = got.select("recording", "sensor", "sha256")
    assert texts.verified_samples(got.drop("sha256"), manifest).count() == 3
    changed = got.drop("sha256").withColumn("samples", F.when(F.col("sensor") == "force", F.reverse("samples")).otherwise(F.col("samples")))
    with pytest.raises(Exception, match="force"):
        texts.verified_samples(changed, manifest).collect()
    pairs = spark.createDataFrame([("r1", "rate", "100"), ("r1", "unit", "g")], "recording string, name string, value string")
    assert recordings.attributes(pairs).first()["attributes"] == {"rate": "100", "unit": "g"}


def test_half_power_peak_is_an_inner_bin(spark):
    power = [9.0, 4.0, 1.0, 0.5, 1.0, 3.0, 8.0, 3.0, 1.0, 0.5, 7.0]
    psd = spark.createDataFrame([("s", i, float(i), p) for i, p in enumerate(power)], "series string, bin int, freq_hz double, power double")
    at = spark.createDataFrame([("s", 0.0), ("s", 6.0), ("s", 10.0)], "series string, frequency_hz double")
    got = {r["frequency_hz"]: r["damping_ratio"] for r in spectral.half_power_damping(psd, at).collect()}
    assert got[0.0] is None and got[10.0] is None and got[6.0] is None  # the crossings are under four bins apart
