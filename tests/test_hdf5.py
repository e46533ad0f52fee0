"""HDF5 files written byte by byte, read by ranges."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.plans import shaker
from tremorlake.sources import hdf5


class Writer:
    """A file of the classic layout, objects first and their groups after them."""

    def __init__(self, version=0):
        self.version, self.body = version, bytearray(96 + 4 * version)

    def put(self, data):
        self.body += b"\0" * (-len(self.body) % 8)
        self.body += data
        return len(self.body) - len(data)

    def header(self, *parts, split=False):
        packed = [struct.pack("<HHB3x", kind, len(d) + -len(d) % 8, 0) + d + b"\0" * (-len(d) % 8) for kind, d in parts]
        count, first = len(packed), packed
        if split:  # all but the first message lie in a continuation
            rest = b"".join(packed[1:])
            first, count = [packed[0], struct.pack("<HHB3xQQ", 0x10, 16, 0, self.put(rest), len(rest))], count + 1
        inside = b"".join(first)
        return self.put(struct.pack("<BBHII4x", 1, 0, count, 1, len(inside)) + inside)

    def tree(self, kind, cells, last, level=0):
        """Nodes of two cells at most, as high as it takes."""
        if len(cells) <= 2:
            inside = b"".join(key + struct.pack("<Q", child) for key, child in cells) + last
            return self.put(b"TREE" + struct.pack("<BBHQQ", kind, level, len(cells), hdf5.NOWHERE, hdf5.NOWHERE) + inside)
        parts = [cells[i : i + 2] for i in range(0, len(cells), 2)]
        return self.tree(kind, [(p[0][0], self.tree(kind, p, last, level)) for p in parts], last, level + 1)

    def group(self, members):
        names, nodes, heap = sorted(members), [], b"\0" * 8
        place = {}
        for name in names:
            place[name] = len(heap)
            heap += name.encode() + b"\0" * (8 - len(name) % 8)
        for i in range(0, len(names), 3):
            part = names[i : i + 3]
            inside = b"".join(struct.pack("<QQII16x", place[n], members[n], 0, 0) for n in part)
            nodes.append((struct.pack("<Q", place[part[0]]), self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(part)) + inside)))
        head = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, self.put(heap)))
        return self.header((0x11, struct.pack("<QQ", self.tree(0, nodes, b"\0" * 8), head)))

    def dataset(self, x, chunk=None, filters=(), skip=(), split=False):
        x = np.asarray(x)
        of = 1 if x.dtype.kind == "f" else 0
        bits = (x.dtype.byteorder == ">") | (8 if x.dtype.kind == "i" else 0)
        parts = [(1, struct.pack("<BB6xQ", 1, x.ndim, x.size)), (3, struct.pack("<BBBBI", 16 | of, bits, 0, 0, x.itemsize) + b"\0" * 12)]
        if chunk is None:
            parts.append((8, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        else:
            cells = []
            for i in range(0, x.size, chunk):
                data = np.resize(np.append(x[i : i + chunk], np.zeros(chunk, x.dtype)), chunk).astype(x.dtype).tobytes()
                if 2 in filters:
                    data = np.frombuffer(data, "u1").reshape(-1, x.itemsize).T.tobytes()
                data = zlib.compress(data) if 1 in filters else data
                data += b"sum!" if 3 in filters else b""
                if i not in skip:
                    cells.append((struct.pack("<IIQQ", len(data), 0, i, 0), self.put(data)))
            parts.append((8, struct.pack("<BBBQII", 3, 2, 2, self.tree(1, cells, b"\0" * 24), chunk, x.itemsize)))
            if filters:
                line = b"".join(struct.pack("<HHHH", n, 0, 0, 1) + struct.pack("<II", 4, 0) for n in filters)
                parts.append((11, struct.pack("<BB6x", 1, len(filters)) + line))
        return self.header(*parts, split=split)

    def saved(self, path, root):
        head = hdf5.SIGNATURE + bytes([self.version, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + b"\x20\0\0\0" * self.version
        head += struct.pack("<QQQQ", 0, hdf5.NOWHERE, len(self.body), hdf5.NOWHERE) + struct.pack("<QQII16x", 0, root, 1, 0)
        self.body[: len(head)] = head
        path.write_bytes(bytes(self.body))
        return str(path)


RNG = np.random.default_rng(3)
LONG, SHORT, WHOLE = RNG.normal(size=20_000), RNG.normal(size=777).astype(">f4"), RNG.integers(-9, 9, 50).astype("<i2")


def written(path, version=0):
    w = Writer(version)
    inside = {"x": w.dataset(LONG, 1500, (2, 1)), "y": w.dataset(SHORT, 100, (1, 3), skip=(200,)), "z": w.dataset(WHOLE, split=True), "plain": w.dataset(LONG + 1), "table": w.dataset(np.zeros((2, 2)))}
    inside |= {f"other{i}": w.dataset(RNG.normal(size=30_000)) for i in range(4)}
    return w.saved(path, w.group({"r1": w.group({"acceleration": w.group(inside), "empty": w.dataset(np.empty(0))})}))


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["dataset"], r["start"])):
        have = out.setdefault((r["file"].rsplit("/", 1)[-1], r["dataset"].rsplit("/", 1)[-1]), [])
        assert r["start"] == len(have)
        have += r["samples"]
    return out


def test_named_datasets_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "PART_BYTES", 40_000)
    monkeypatch.setattr(hdf5, "ROW_SAMPLES", 1000)
    files = [written(tmp_path / "a.h5"), written(tmp_path / "b.h5", 1)]
    df = hdf5.read_subset(spark, files, [f"r1/acceleration/{n}" for n in ("x", "y", "z", "plain")] + ["r1/empty"])
    got = found(df.collect())
    y = SHORT.astype(float)
    y[200:300] = 0
    for name in ("a.h5", "b.h5"):
        assert got[name, "x"] == LONG.tolist() and got[name, "y"] == y.tolist() and got[name, "z"] == WHOLE.tolist() and got[name, "plain"] == (LONG + 1).tolist()
    assert len(got) == 8 and df.rdd.getNumPartitions() >= 16  # the long datasets lie in several partitions


def test_only_what_is_named_is_read(tmp_path):
    path = written(tmp_path / "a.h5")
    size = len((tmp_path / "a.h5").read_bytes())
    with hdf5.Ranges(path) as f:
        kind, filters, pieces = hdf5.planned(f, "/r1/acceleration/y")
        assert f.total < 4000 and size > 1_000_000  # the headers on the way
        before = f.total
        for _, _, place, stored, _ in pieces:
            if place >= 0:
                f.at(place, stored)
        assert f.total - before == sum(p[3] for p in pieces) < 4 * SHORT.size
        assert filters == [1, 3] and kind == ">f4"


def test_values_and_refusals(spark, tmp_path):
    w = Writer()
    path = w.saved(tmp_path / "n.h5", w.group({"v": w.dataset(np.array([1.0, np.nan, np.inf, -2.0])), "table": w.dataset(np.zeros((2, 2)))}))
    assert hdf5.read_subset(spark, [path], ["v"]).first()["samples"] == [1.0, None, None, -2.0]
    assert hdf5.read_subset(spark, [path], []).count() == 0
    (tmp_path / "bad.h5").write_bytes(b"no such file" * 9)
    (tmp_path / "cut.h5").write_bytes((tmp_path / "n.h5").read_bytes()[:-300])
    for file, name, said in ((path, "w", "has no w"), (path, "table", "2 dimensions"), (path, "/", "has no"), (str(tmp_path / "bad.h5"), "v", "not an HDF5"), (str(tmp_path / "cut.h5"), "v", "ends inside")):
        with pytest.raises(Exception, match=said):
            hdf5.read_subset(spark, [file], [name]).collect()


def test_shaker_samples_and_command(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "ROW_SAMPLES", 100)
    w, want = Writer(), {}
    recordings = {}
    for name, n in (("ref", 1200), ("good", 1000)):
        x, y, z = RNG.normal(size=n), RNG.normal(size=n), RNG.normal(size=n - 7)
        want[name] = x, y, z
        sensors = {"AS": w.group({"z": w.dataset(x)}), "AG01": w.group({"z": w.dataset(y, 128, (2, 1)), "x": w.dataset(y)}), "AG02": w.group({"z": w.dataset(z, 300)})}
        recordings[name] = w.group({"acceleration": w.group(sensors)})
    path = w.saved(tmp_path / "s.h5", w.group(recordings))
    got = shaker.read_shaker_subset(spark, path, ["ref", "good"], "AS/z", ["AG02/z", "AG01/z"]).orderBy("recording", "idx").collect()
    for name, (x, y, z) in want.items():
        rows = [r for r in got if r["recording"] == name]
        assert [r["idx"] for r in rows] == list(range(len(z)))  # up to the shortest sensor's end
        assert [(r["excitation"], *r["responses"]) for r in rows] == list(zip(x, y, z))
    argv = ["--fetch", "--source", path, "--cache", str(tmp_path / "cache"), "--reference", "ref", "--holdout", "good", "--responses", "AG01/z", "AG02/z"]
    monkeypatch.setattr(shaker, "run_study", lambda samples, *_: {"states": samples.groupBy("recording").agg(F.count("*").alias("arm")).withColumnRenamed("recording", "label")})
    monkeypatch.setattr(shaker.reports, "finish", lambda result, _: {r["label"]: r["arm"] for r in result["states"].collect()})
    assert shaker.main(argv) == {"ref": 1193, "good": 993}
