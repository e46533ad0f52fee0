"""Variables of level-5 MAT files, read without further libraries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the file format: element types and their numpy kinds, array classes, the flag of complex arrays.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
CELLS, STRUCTURE, CHARS = 1, 2, 4
NARROW, UTF8 = (1, 2), 16
COMPLEX = 0x0800
HEADER = 128


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """Type and bytes of the elements one after another; those of four bytes or fewer may lie in their own tag."""
    at = 0
    while at + 8 <= len(data):
        word, size = struct.unpack_from(f"{order}II", data, at)
        kind, short = word & 0xFFFF, word >> 16
        start, size = (at + 4, short) if short else (at + 8, size)
        if start + size > len(data):
            raise ValueError("the file ends inside an element")
        yield kind, data[start : start + size]
        # what is compressed isn't padded
        at = at + 8 if short else start + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _numbers(kind: int, data: memoryview, order: str) -> np.ndarray:
    return np.frombuffer(data, np.dtype(KINDS[kind]).newbyteorder(order))


def _text(kind: int, data: memoryview, shape: list[int], order: str):
    """A row of characters as a text, several rows as a list of texts without their padding."""
    if kind in (UTF8, *NARROW):
        line = bytes(data).decode("utf-8" if kind == UTF8 else "latin-1")
    else:
        line = bytes(data).decode("utf-16-le" if order == "<" else "utf-16-be")
    rows = shape[0]
    return line if rows <= 1 else [line[i::rows].rstrip() for i in range(rows)]


def _value(data: memoryview, order: str):
    """Name and value of a matrix element: an array, a text, a list (cells) or a dict (a structure of one element); None for other classes."""
    if not len(data):
        return "", None
    parts = _elements(data, order)
    flags = int(_numbers(*next(parts), order)[0])
    shape = [int(n) for n in _numbers(*next(parts), order)]
    name, of = bytes(next(parts)[1]).decode("latin-1"), flags & 0xFF
    if of in NUMERIC:
        values = _numbers(*next(parts), order).astype(NUMERIC[of])
        if flags & COMPLEX:
            values = values + 1j * _numbers(*next(parts), order)
        return name, values.reshape(shape, order="F")
    if of == CHARS:
        return name, _text(*next(parts), shape, order)
    if of == CELLS:
        return name, [_value(d, order)[1] for _, d in parts]
    if of == STRUCTURE:
        width = int(_numbers(*next(parts), order)[0])
        names = bytes(next(parts)[1])
        fields = [names[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(names), width)]
        return name, dict(zip(fields, (_value(d, order)[1] for _, d in parts))) if np.prod(shape) == 1 else None
    return name, None


def variables(content: bytes) -> Iterator[tuple[str, object]]:
    """Name and value of each variable, inflated one at a time; None for sparse arrays, objects and arrays of structures."""
    mark = bytes(content[126:HEADER])
    if mark not in (b"IM", b"MI") or content[:4] == b"\0\0\0\0":
        raise ValueError("not a level-5 MAT file")
    order = "<" if mark == b"IM" else ">"
    for kind, data in _elements(memoryview(content)[HEADER:], order):
        inner = _elements(memoryview(zlib.decompress(data)), order) if kind == COMPRESSED else [(kind, data)]
        for kind, data in inner:
            if kind == MATRIX:
                yield _value(data, order)


def arrays(content: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """The numeric arrays with their names; those of a structure are named ``structure.field``."""
    waiting = list(variables(content))[::-1]
    while waiting:
        name, value = waiting.pop()
        if isinstance(value, np.ndarray):
            yield name, value
        elif isinstance(value, dict):
            waiting += [(f"{name}.{k}", v) for k, v in reversed(value.items())]
