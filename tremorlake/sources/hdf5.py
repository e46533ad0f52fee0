"""One-dimensional datasets of HDF5 files, read by ranges: what isn't named isn't read.

Files of the classic layout (superblock 0 or 1, groups as symbol tables, object headers of version 1), as the format's library writes by
default. The driver reads the headers on the way to the named datasets; tasks read the datasets' bytes, up to ``PART_BYTES`` a task, so one long
dataset is spread over many. Files may be of any size.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, dataset string, start bigint, samples array<double>"
#: Stored bytes that one task reads, at least one chunk; and samples that a row holds at most.
PART_BYTES, ROW_SAMPLES = 64 << 20, 1 << 18

# Fixed values of the file format: the signature, message types, layout classes and filter numbers.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, DATATYPE, LAYOUT, FILTERS, CONTINUATION, SYMBOLS = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
COMPACT, CONTIGUOUS, CHUNKED = 0, 1, 2
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
NOWHERE = 0xFFFFFFFFFFFFFFFF


class Ranges:
    """A file read by position; ``total`` counts the bytes."""

    def __init__(self, path: str):
        self.file, self.total, self.path = open(path.removeprefix("file://"), "rb"), 0, path

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(size)
        self.total += len(data)
        if len(data) < size:
            raise ValueError(f"{self.path} ends inside what it describes")
        return data

    def unpacked(self, place: int, form: str) -> tuple:
        return struct.unpack(f"<{form}", self.at(place, struct.calcsize(f"<{form}")))

    def marked(self, place: int, mark: bytes) -> int:
        if self.at(place, 4) != mark:
            raise ValueError(f"{self.path} has no {mark.decode()} at {place}")
        return place + 4


def root_of(f: Ranges) -> int:
    if f.at(0, 8) != SIGNATURE:
        raise ValueError(f"{f.path} is not an HDF5 file")
    version, *_, offsets, lengths = f.unpacked(8, "7B")[:7]
    if version > 1 or (offsets, lengths) != (8, 8):
        raise ValueError(f"{f.path} has superblock {version}; only 0 and 1 with places of 8 bytes are read")
    # behind the two or three group sizes and flags: four addresses, then the root's entry with its name's place first
    return f.unpacked(24 + 4 * version + 32 + 8, "Q")[0]


def messages(f: Ranges, header: int) -> dict[int, bytes]:
    """The messages of an object by type; of a repeated type the first."""
    version, _, count, _, size = f.unpacked(header, "BBHII")
    if version != 1:
        raise ValueError(f"{f.path} has an object header that is not of version 1")
    found, blocks = {}, [(header + 16, size)]
    while blocks:
        block, at = f.at(*blocks.pop(0)), 0
        while at + 8 <= len(block) and count:
            kind, n = struct.unpack_from("<HH", block, at)
            body = block[at + 8 : at + 8 + n]
            if kind == CONTINUATION:
                blocks.append(struct.unpack_from("<QQ", body))
            found.setdefault(kind, body)
            at, count = at + 8 + n, count - 1
    return found


def leaves(f: Ranges, node: int, kind: int, key: int) -> Iterator[tuple[bytes, int]]:
    """Key and child of the lowest level of a tree, in order."""
    place = f.marked(node, b"TREE")
    of, level, used = f.unpacked(place, "BBH")
    if of != kind:
        raise ValueError(f"{f.path} has a tree of kind {of} where one of kind {kind} belongs")
    body = f.at(node + 24, used * (key + 8))
    for i in range(used):
        cell = body[i * (key + 8) : (i + 1) * (key + 8)]
        child = struct.unpack_from("<Q", cell, key)[0]
        if level:
            yield from leaves(f, child, kind, key)
        else:
            yield cell[:key], child


def members(f: Ranges, header: int) -> dict[str, int]:
    """Names of a group with the places of their object headers."""
    table = messages(f, header).get(SYMBOLS)
    if table is None:
        return {}
    tree, heap = struct.unpack_from("<QQ", table)
    size, _, segment = f.unpacked(f.marked(heap, b"HEAP") + 4, "QQQ")
    names, found = f.at(segment, size), {}
    for _, node in leaves(f, tree, 0, 8):
        place = f.marked(node, b"SNOD")
        count = f.unpacked(place, "BBH")[2]
        body = f.at(node + 8, 40 * count)
        for i in range(count):
            name, child = struct.unpack_from("<QQ", body, 40 * i)
            found[names[name : names.index(b"\0", name)].decode()] = child
    return found


def located(f: Ranges, dataset: str) -> int:
    place = root_of(f)
    for part in dataset.strip("/").split("/"):
        inside = members(f, place)
        if part not in inside:
            raise ValueError(f"{f.path} has no {dataset}")
        place = inside[part]
    return place


def _kind(body: bytes) -> str:
    of, bits, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    if of not in (0, 1):
        raise ValueError("only numbers are read")
    return f"{'>' if bits & 1 else '<'}{'f' if of else 'i' if bits & 8 else 'u'}{size}"


def _filters(body: bytes | None) -> list[int]:
    """Filter numbers in the order of writing."""
    if body is None:
        return []
    version, count, at, found = body[0], body[1], 8 if body[0] == 1 else 2, []
    for _ in range(count):
        number = struct.unpack_from("<H", body, at)[0]
        named = version == 1 or number >= 256
        length = struct.unpack_from("<H", body, at + 2)[0] if named else 0
        values = struct.unpack_from("<H", body, at + (6 if named else 4))[0]
        at += (8 if named else 6) + (-(-length // 8) * 8 if version == 1 else length) + 4 * (values + (values % 2 if version == 1 else 0))
        found.append(number)
    return found


def planned(f: Ranges, dataset: str) -> tuple[str, list[int], list[tuple[int, int, int, int, int]]]:
    """Type, filters and pieces (first sample, samples, place, bytes, mask of filters left out) of a dataset; place -1 for zeros that were never written."""
    found = messages(f, located(f, dataset))
    if LAYOUT not in found:
        raise ValueError(f"{dataset} of {f.path} is no dataset")
    space, layout, kind = found[DATASPACE], found[LAYOUT], _kind(found[DATATYPE])
    if space[1] != 1 or layout[0] != 3:
        raise ValueError(f"{dataset} of {f.path} has {space[1]} dimensions in layout {layout[0]}; one in layout 3 is read")
    n, width = struct.unpack_from("<Q", space, 8 if space[0] == 1 else 4)[0], np.dtype(kind).itemsize
    if layout[1] == COMPACT:
        raise ValueError(f"{dataset} of {f.path} lies in its header, which isn't read")
    if layout[1] == CONTIGUOUS:
        place, step = struct.unpack_from("<Q", layout, 2)[0], ROW_SAMPLES
        return kind, [], [(i, min(step, n - i), place + i * width if place != NOWHERE else -1, min(step, n - i) * width, 0) for i in range(0, n, step)]
    tree, length = struct.unpack_from("<QI", layout, 3)
    stored = {}
    for key, child in leaves(f, tree, 1, 24) if tree != NOWHERE else ():
        size, mask, first = struct.unpack_from("<IIQ", key)
        stored[first] = child, size, mask
    return kind, _filters(found.get(FILTERS)), [(i, min(length, n - i), *stored.get(i, (-1, 0, 0))) for i in range(0, n, length)]


def decoded(data: bytes, kind: str, filters: list[int], mask: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    for i in range(len(filters) - 1, -1, -1):
        if mask >> i & 1:
            continue
        if filters[i] == DEFLATE:
            data = zlib.decompress(data)
        elif filters[i] == SHUFFLE:
            data = np.frombuffer(data, "u1").reshape(width, -1).T.tobytes()
        elif filters[i] == CHECKSUM:
            data = data[:-4]
        else:
            raise ValueError(f"filter {filters[i]} is not read")
    return np.frombuffer(data, kind)


class Piece(InputPartition):
    def __init__(self, path: str, dataset: str, kind: str, filters: list[int], pieces: list):
        self.path, self.dataset, self.kind, self.filters, self.pieces = path, dataset, kind, filters, pieces


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], datasets: list[str]):
        self.paths, self.datasets = paths, datasets

    def partitions(self) -> list[Piece]:
        out = []
        for path in self.paths:
            with Ranges(path) as f:
                for name in self.datasets:
                    kind, filters, pieces = planned(f, name)
                    group, size = [], 0
                    for piece in pieces:
                        if group and size + piece[3] > PART_BYTES:
                            out.append(Piece(path, name, kind, filters, group))
                            group, size = [], 0
                        group.append(piece)
                        size += piece[3]
                    if group:
                        out.append(Piece(path, name, kind, filters, group))
        return out or [Piece("", "", "<f8", [], [])]

    def read(self, partition: Piece):
        if not partition.pieces:
            return
        with Ranges(partition.path) as f:
            for first, n, place, size, mask in partition.pieces:
                x = np.zeros(n) if place < 0 else decoded(f.at(place, size), partition.kind, partition.filters, mask)[:n].astype(float)
                for at in range(0, n, ROW_SAMPLES):
                    yield partition.path, partition.dataset, first + at, [v if v == v and abs(v) != float("inf") else None for v in x[at : at + ROW_SAMPLES].tolist()]


class Hdf5Subset(DataSource):
    """Options ``paths`` and ``datasets``, both JSON lists."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_subset"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["paths"]), json.loads(self.options["datasets"]))


def read_subset(spark: SparkSession, paths: list[str], datasets: list[str]) -> DataFrame:
    """``file, dataset, start, samples``: the named datasets' samples by ranges, those that aren't finite as null; unwritten chunks are zeros.

    A file or dataset that is absent, or of a form that isn't read, is an error.
    """
    spark.dataSource.register(Hdf5Subset)
    return spark.read.format("hdf5_subset").option("paths", json.dumps(list(paths))).option("datasets", json.dumps(list(datasets))).load()
