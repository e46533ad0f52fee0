"""MAT files written byte by byte, read back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.functions.columns import datenum_time
from tremorlake.sources import matlab, recordings


def element(kind, data, order="<", short=True):
    if short and 0 < len(data) <= 4:
        return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, of, shape, *parts, order="<", flags=0):
    head = element(6, struct.pack(f"{order}II", of | flags, 0), order, False) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)
    return element(14, head + b"".join(parts), order, False)


def doubles(name, x, order="<"):
    x = np.atleast_2d(np.asarray(x, float))
    return matrix(name, 6, x.shape, element(9, x.astype(f"{order}f8").tobytes(order="F"), order), order=order)


def chars(text):
    return matrix("", 4, (1, len(text)), element(4, text.encode("utf-16-le")))


def structure(name, fields):
    names = b"".join(k.encode().ljust(32, b"\0") for k in fields)
    return matrix(name, 2, (1, 1), element(5, struct.pack("<i", 32)), element(1, names), *fields.values())


def file(*parts, mark=b"IM", version=b"\0\1"):
    return b"MATLAB 5.0 MAT-file".ljust(124) + version + mark + b"".join(parts)


def packed(part):
    data = zlib.compress(part)
    return struct.pack("<II", 15, len(data)) + data


X = np.arange(6.0).reshape(2, 3) / 7


def test_values_of_each_kind():
    small = matrix("small", 6, (1, 3), element(2, bytes([1, 2, 250])))  # doubles kept as bytes, in their own tag
    both = matrix("both", 6, (1, 2), element(9, np.array([1.0, 2.0]).tobytes()), element(9, np.array([3.0, -4.0]).tobytes()), flags=0x0800)
    cells = matrix("names", 1, (1, 2), chars("ab"), chars("a longer name"))
    lines = matrix("lines", 4, (2, 3), element(16, b"abcde "))
    several = matrix("several", 2, (1, 2), element(5, struct.pack("<i", 32)), element(1, b"f".ljust(32, b"\0")), doubles("", [1.0]), doubles("", [2.0]))
    got = dict(matlab.variables(file(packed(doubles("x", X)), small, packed(both), cells, lines, several, packed(doubles("none", np.empty((0, 0)))))))
    assert np.array_equal(got["x"], X) and got["small"].tolist() == [[1.0, 2.0, 250.0]] and got["small"].dtype == np.float64
    assert got["both"].tolist() == [[1 + 3j, 2 - 4j]] and got["names"] == ["ab", "a longer name"]
    assert got["lines"] == ["ace", "bd"] and got["several"] is None and got["none"].size == 0
    assert list(matlab.variables(file())) == []


def test_big_endian_files_and_damage():
    whole = file(doubles("x", X, ">"), mark=b"MI", version=b"\1\0")
    assert np.array_equal(dict(matlab.arrays(whole))["x"], X)
    for bad in (whole[:-8], b"x" * 200, b""):
        with pytest.raises(ValueError):
            list(matlab.arrays(bad))


def test_tables_of_files(spark, tmp_path):
    f = np.array([[1.5, 2.5], [np.nan, 2.6], [1.7, np.inf]])
    env = np.array([[10.0, 80.0], [11.0, np.nan], [12.0, 70.0]])
    labels = matrix("", 1, (2, 1), chars("deck"), chars("air"))
    modes = structure("modes", {"sdn": doubles("", np.array([[737334.0], [737334.5], [737335.0]])), "f": doubles("", f), "env": doubles("", env), "labels_env": labels})
    (tmp_path / "a.mat").write_bytes(file(packed(modes), doubles("rate", [100.0])))
    (tmp_path / "b.mat").write_bytes(file(modes))
    rows = recordings.read_tracked_modes(spark, str(tmp_path / "*.mat")).withColumn("ts", datenum_time(F.col("sdn")).cast("string"))
    for name in "ab":
        got = rows.where(F.col("file").endswith(f"{name}.mat")).orderBy("hour").collect()
        assert [r["frequencies"] for r in got] == [[1.5, 2.5], [None, 2.6], [1.7, None]]
        assert [r["environment"] for r in got] == [{"deck": 10.0, "air": 80.0}, {"deck": 11.0, "air": None}, {"deck": 12.0, "air": 70.0}]
        assert got[0]["ts"] < got[1]["ts"] < got[2]["ts"]
    sensors = {r["sensor"]: r["samples"] for r in recordings.read_mat(spark, str(tmp_path / "a.mat")).collect()}
    assert sensors["modes.sdn"] == [737334.0, 737334.5, 737335.0] and sensors["modes.f_1"][:2] == [2.5, 2.6] and set(sensors) == {"modes.sdn", "modes.f_0", "modes.f_1", "modes.env_0", "modes.env_1"}
    with pytest.raises(Exception, match="no structure"):
        recordings.read_tracked_modes(spark, str(tmp_path / "a.mat"), "other").count()
