"""Whole studies on synthetic recordings, archives and openings."""

import datetime as dt
import io
import json
import zipfile

import numpy as np
import pandas as pd

from tremorlake.plans import extraction, monitor, openings, shaker
from tremorlake.sources import texts


def oscillator(u, frequencies, weights, rate):
    """Displacements of lightly damped oscillators driven by one force."""
    out = np.zeros((len(u), weights.shape[1]))
    for f, w in zip(frequencies, weights):
        om, z, sub = 2 * np.pi * f, 0.02, 4
        x = v = 0.0
        for i, force in enumerate(u):
            for _ in range(sub):
                v += (force - 2 * z * om * v - om * om * x) / rate / sub
                x += v / rate / sub
            out[i] += w * x * om * om
    return out


def test_shaker_study(spark):
    rng = np.random.default_rng(0)
    n, rate = 50 * 610, 50.0
    frames = []
    weights = np.array([[1.0, 0.5], [0.4, -1.0]])
    for name, modes in (("ref", (4.0, 9.5)), ("good", (4.0, 9.5)), ("bad", (3.6, 9.5))):
        u = rng.normal(size=n)
        y = oscillator(u, modes, weights, rate) + 0.01 * rng.normal(size=(n, 2))
        frames.append(pd.DataFrame({"recording": name, "idx": range(n), "excitation": u, "responses": y.tolist()}))
    labels = spark.createDataFrame([("ref", "reference"), ("good", "holdout"), ("bad", "moved")], "recording string, label string")
    out = shaker.run_study(spark.createDataFrame(pd.concat(frames)), rate, labels, "ref", 0.2)
    assert out["bands"].count() == 2
    moved = out["states"].where("label = 'moved' and arm = 'raw_frequencies'").first()
    assert moved["samples"] == 10 and moved["alarm_rate"] == 1.0
    shift = {r["feature"]: r["relative_shift"] for r in out["shifts"].where("label = 'moved'").collect()}
    assert abs(shift["m0"] + 0.1) < 0.03 and abs(shift["m1"]) < 0.02


def test_archive_study(spark):
    rng = np.random.default_rng(1)
    files, n = [], 2048 * 9
    for record, f in (("01A00", 4.0), ("01A01", 4.1), ("06A02", 4.2)):
        t = np.arange(n) / 100
        x = np.outer(np.sin(2 * np.pi * f * t + rng.random()), [1.0, 0.6, 0.3]) + 0.1 * rng.normal(size=(n, 3))
        x[:, 2] *= 50 if record == "06A02" else 1
        for k, c in enumerate("abc"):
            files.append((record, f"{record}{c}.AAA".lower(), "h\n%d\nu\n" % n + "\n".join(f"{v:.6f}" for v in x[:, k])))
        files.append((record, f"{record}PRE.ENV", "T1 [C]\n8.0\n9.0\nend\n"))
    files.append(("01A03", "01a03a.aaa", "h\n2\nu\n1\n2\n"))
    table = spark.createDataFrame(files, "name string, file string, content string").cache()
    config = {"channels": ["a", "b", "c"], "name_origin": "2000-01-01", "voltage_conversions": {}}
    reference = ("2000-01-01", "2000-03-01")
    out = extraction.extract(table, config, 100.0, reference)
    assert [r[0] for r in out["incomplete"].collect()] == ["01A03"]
    assert sorted(r[0] for r in out["channels"].collect()) == ["a", "b"]
    record, covariates, modes = extraction.tracked_record(out["spectra"].cache(), out["environment"], ["T1"], reference)
    assert covariates.where("temperature_c = 8.5").count() == 3
    best = modes.orderBy("freq_hz").first()["mode"]
    got = record.where(f"mode = {best}").orderBy("ts").toPandas()["freq_hz"].to_numpy()
    assert np.abs(got - [4.0, 4.1, 4.2]).max() < 0.05


def test_openings_study(spark):
    rng = np.random.default_rng(3)
    rows = []
    start = dt.datetime(2023, 2, 20)
    for i in range(60):
        ts = start + dt.timedelta(hours=6 * i)
        label = "reference" if i < 40 else "changed"
        for c in ("g1", "g2", "g3"):
            for angle in (-30.0, -60.0):
                v = rng.normal() + (8 if label == "changed" and c == "g2" else 0) + (200 if c == "g3" and i % 8 == 0 else 0)
                rows.append((f"f{i}", label, c, angle, float(v)))
    features = spark.createDataFrame(rows, "file string, label string, channel string, angle double, feature double")
    out = openings.run_study(features, 0.05, max_deviation=True, without_erratic=True)
    assert [r[0] for r in out["erratic"].collect()] == ["g3"]
    states = {(r["arm"], r["label"]): r["alarm_rate"] for r in out["states"].collect()}
    assert states["raw_frequencies", "changed"] == 1.0 and states["max_deviation", "changed"] == 1.0
    assert {r["feature"] for r in out["top_shifts"].where("rank <= 2").collect()} == {"g2_30", "g2_60"}


def test_openings_from_samples(spark):
    n = 6000
    inc = np.r_[np.full(2500, -1.1), np.linspace(-1.1, -74, 3500)]
    frames = [pd.DataFrame({"file": f, "idx": range(n), "inclination": inc, "channel": c, "value": -1e6 if c == "dead" else 2 * inc}) for f in ("a", "b") for c in ("g1", "dead")]
    times = spark.createDataFrame([("a", dt.datetime(2023, 2, 21)), ("b", dt.datetime(2023, 3, 9, 23, 45, 25))], "file string, start_ts timestamp")
    got = openings.labelled_features(spark.createDataFrame(pd.concat(frames)), times, ("2023-02-20", "2023-03-03"), "2023-03-09", "2023-03-09 23:45:25")
    assert {(r["file"], r["label"], r["channel"]) for r in got.collect()} == {("a", "reference", "g1"), ("b", "event", "g1")}


def test_monitor_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    rows, cov, start = [], [], dt.datetime(2020, 1, 1)
    for h in range(24 * 30):
        t = 4 + 8 * np.sin(2 * np.pi * h / 240) + rng.normal(0, 0.5)
        cov.append((start + dt.timedelta(hours=h), float(t)))
        for m, base in ((1, 2.0), (2, 3.5)):
            rows.append((start + dt.timedelta(hours=h), m, float(base * (1 - 4e-4 * t) * (0.99 if h >= 24 * 25 else 1) + rng.normal(0, 5e-4))))
    spark.createDataFrame(rows, "ts timestamp, mode int, freq_hz double").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame(cov, "ts timestamp, temperature_c double").write.parquet(str(tmp_path / "c"))
    args = ["--record", str(tmp_path / "r"), "--covariates", str(tmp_path / "c"), "--reference", "2020-01-01", "2020-01-21", "--holdout", "2020-01-21", "2020-01-26", "--changed", "2020-01-26", "2020-01-31"]
    assert monitor.main([*args, "--alpha", "0.1", "--arms", "temperature_normalized", "--json-out", str(tmp_path / "o.json")]) == 0
    assert "temperature_normalized" in capsys.readouterr().out
    out = json.loads((tmp_path / "o.json").read_text())
    rates = {(a["arm"], a["segment"]): a["alarm_rate"] for a in out["alarms"]}
    assert rates["temperature_normalized", "changed"] == 1.0 and out["modes"] == [1, 2]


def test_commands_without_data(spark, tmp_path, capsys):
    none = str(tmp_path / "none")
    config = tmp_path / "c.json"
    config.write_text(json.dumps(dict.fromkeys(texts.CONFIG_FIELDS, {})))
    segments = ["--reference", "2020-01-01", "2020-01-21", "--holdout", "2020-01-21", "2020-01-26", "--changed", "2020-01-26", "2020-01-31"]
    assert monitor.main(["--record", none, "--covariates", none, *segments]) == 2
    assert shaker.main(["--cache", none, "--reference", "a", "--holdout", "b"]) == 2
    assert extraction.main(["--fdd", none, "--config", none]) == 2
    assert extraction.main(["--fdd", none, "--config", str(config)]) == 2
    assert openings.main(["--features", none]) == 2
    assert none in capsys.readouterr().err


def test_shaker_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    n, rate = 50 * 610, 50.0
    (tmp_path / "npz").mkdir()
    for name, modes in (("s1", (4.0, 9.5)), ("s2", (4.0, 9.5)), ("cut", (3.6, 9.5))):
        u = rng.normal(size=n)
        y = oscillator(u, modes, np.array([[1.0, 0.5], [0.4, -1.0]]), rate) + 0.01 * rng.normal(size=(n, 2))
        np.savez(tmp_path / "npz" / f"{name}.npz", excitation=u, y1=y[:, 0], y2=y[:-5, 1])
    args = ["--cache", str(tmp_path / "cache"), "--sampling-hz", "50", "--reference", "s1", "--holdout", "s2", "--alpha", "0.2", "--json-out", str(tmp_path / "o.json")]
    assert shaker.main([*args, "--fetch", "--source", str(tmp_path / "npz" / "*.npz")]) == 0
    assert spark.read.parquet(str(tmp_path / "cache")).groupBy("recording").count().where(f"count = {n - 5}").count() == 3
    states = {(r["arm"], r["label"]): r for r in json.loads((tmp_path / "o.json").read_text())["states"]}
    assert states["raw_frequencies", "cut"]["alarm_rate"] == 1.0 and {label for _, label in states} == {"holdout", "cut"}
    assert "raw_frequencies" in capsys.readouterr().out


def test_openings_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(9)
    n = 2600
    inc = np.r_[np.full(2100, -1.1), np.linspace(-1.1, -74, 500)]
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        for i in range(36):
            ts = dt.datetime(2023, 2, 20) + dt.timedelta(hours=12 * i)
            g = inc * 2 + rng.normal(0, 0.2) + np.outer((inc < -20), [1, 1])[:, 0] * (rng.normal() + (30 if i >= 36 - 4 else 0))
            pd.DataFrame({"tilt": inc, "g1": g, "g2": inc + (inc < -20) * rng.normal()}).to_csv(z.open(f"x/{ts:%Y_%m_%dT%H_%M_%S}.csv", "w"), index=False)
    args = ["--features", str(tmp_path / "f"), "--reference", "2023-02-20", "2023-03-05", "--holdout-end", "2023-03-07", "--event", "2023-03-07 00:00:00", "--alpha", "0.1"]
    assert openings.main([*args, "--fetch", "--source", str(tmp_path / "o.zip"), "--inclination", "tilt", "--gauges", "g1", "g2", "--json-out", str(tmp_path / "o.json")]) == 0
    out = json.loads((tmp_path / "o.json").read_text())
    assert len(out["features"]) == 36 and any(s["label"] == "changed" for s in out["states"])
    assert openings.main([*args, "--max-deviation"]) == 0
    assert "max_deviation" in capsys.readouterr().out


def test_archive_command(spark, tmp_path, capsys):
    rng = np.random.default_rng(11)
    n, buffer = 2048 * 9, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for h in range(8 * 5):
            record = f"01{'ABCDE'[h // 8]}{h % 8:02d}"
            t = np.arange(n) / 100
            x = np.outer(np.sin(2 * np.pi * (4 + 0.02 * rng.normal()) * t + rng.random()), [1.0, 0.6]) + 0.1 * rng.normal(size=(n, 2))
            inside = io.BytesIO()
            with zipfile.ZipFile(inside, "w", zipfile.ZIP_DEFLATED) as r:
                for k, c in enumerate("ab"):
                    r.writestr(f"{record}{c}.AAA", "h\n%d\nu\n" % n + "\n".join(f"{v:.4f}" for v in x[:, k]))
                r.writestr(f"{record}PRE.ENV", f"T1 [C] P1 [C] A [C] H [%] W [m/s]\n{(8 if h % 3 else -3) + rng.random():.3f} {9 + rng.random():.3f} {7 + rng.random():.3f} {60 + rng.random():.3f} {2 + rng.random():.3f}\nend\n")
            z.writestr(record, inside.getvalue())
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    config = {"channels": ["a", "b"], "name_origin": "2000-01-01", "deck_temperatures": ["T1"], "pavement_temperatures": ["P1"], "air_temperature": "A", "humidity": "H", "wind_speed": "W", "voltage_conversions": {}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    days = ["--reference", "2000-01-01", "2000-01-04", "--holdout", "2000-01-04", "2000-01-05", "--changed", "2000-01-05", "2000-01-06", "--alpha", "0.4"]
    args = ["--fdd", str(tmp_path / "t"), "--config", str(tmp_path / "c.json"), *days, "--environment", "--arms", "--json-out", str(tmp_path / "o.json")]
    assert extraction.main([*args, "--extract", "--archive", str(tmp_path / "a.zip"), "--modes", "0"]) == 0
    tables = {k: spark.read.parquet(str(tmp_path / "t" / k)) for k in extraction.TABLES}
    assert tables["damaged"].count() == 0 and tables["spectra"].select("ts").distinct().count() == 40
    assert extraction.weather(tables["environment"], config).dropna().count() == 40
    out = json.loads((tmp_path / "o.json").read_text())
    assert {a["segment"]: a["days"] for a in out["alarms"]} == {"reference": 3, "holdout": 1, "changed": 1} and out["reference_days"] == 3
    assert out["damaged"] == out["incomplete"] == [] and any(abs(f - 4) < 0.2 for f in out["reference_modes_hz"])
