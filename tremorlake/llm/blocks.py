"""Documents in compressed blocks, and packed requests between blocks and buckets.

An operator that needs, for each of many small values in a text, something that only the whole corpus
knows (an id, a count, a first holder) sends each distinct value of a block to the bucket of its hash,
gets one answer per request back, and reads it beside the block. What a block needs afterwards is shuffled
once, compressed; what travels otherwise is bounded by the distinct values per block. A cell between a block
and a bucket is made only where the block has a value for the bucket, so there are never more cells than values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches

BLOCK_BYTES = 4 << 20


#: Bytes of text whose values meet in a bucket, on average.
BUCKET_BYTES = 4 << 20


def bucket_count(docs: DataFrame, buckets_bytes: int | None = None) -> int:
    """Several buckets per shuffle partition, and so many that a bucket keeps its size as the texts grow (one sum over their lengths)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (buckets_bytes or BUCKET_BYTES)))


def blocks_of(batches, block_bytes: int):
    """The columns of neighbouring rows as lists, about ``block_bytes`` of text at a time; a null text is empty."""
    columns, held = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                columns = columns or [[] for _ in row]
                for c, x in zip(columns, row):
                    c.append(x)
                columns[1][-1] = row[1] or ""
                held += len(columns[1][-1])
                if held >= block_bytes:
                    yield columns
                    columns, held = None, 0
    if columns:
        yield columns


def cells(docs: DataFrame, cut, *extra: str, block_bytes: int | None = None) -> DataFrame:
    """``key, block, data``: what ``cut(ids, texts, *extra)`` keeps of each block (under a negative key) and asks of each bucket (under the bucket's number).

    ``cut`` returns bytes and a dictionary from buckets to bytes. Both kinds of rows go through one exchange,
    which ``answered`` and ``assembled`` share, so a text is read and cut once.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        for columns in blocks_of(batches, block_bytes or BLOCK_BYTES):
            kept, asked = cut(*columns)
            number = -(xxhash.xxh64_intdigest(kept) >> 1) - 1
            yield pa.RecordBatch.from_pydict({"key": pa.array([number, *asked], pa.int64()), "block": pa.array([number] * (1 + len(asked)), pa.int64()), "data": pa.array([kept, *asked.values()], pa.binary())})
        release()

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra).mapInArrow(run, "key bigint, block bigint, data binary").repartition("key")


def answered(asked: DataFrame, answer) -> DataFrame:
    """``key, bucket, data``: for each request to a bucket its answer, under the block's key. ``answer`` gets all requests of a bucket."""

    def run(group):
        import pyarrow as pa

        if group.column("key")[0].as_py() < 0:
            group = group.slice(0, 0)
        out = answer(group.column("data").to_pylist()) if group.num_rows else []
        return pa.table({"key": group.column("block"), "bucket": group.column("key"), "data": pa.array(out, pa.binary())})

    return asked.groupBy("key").applyInArrow(run, "key bigint, bucket bigint, data binary")


def assembled(kept: DataFrame, answers: DataFrame, assemble, schema: str) -> DataFrame:
    """What ``assemble(data, answers by bucket)`` makes of each block, as Arrow tables of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(mine, replies):
        import pyarrow as pa

        if not mine.num_rows or mine.column("key")[0].as_py() >= 0:
            return arrow.empty_table()
        found = dict(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist()))
        return pa.concat_tables([assemble(data, found).cast(arrow) for data in mine.column("data").to_pylist()]).combine_chunks()

    return kept.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(run, schema)


def planes(x) -> bytes:
    """The bytes of numbers, those of equal weight together (by shifts, which is faster than a transposition)."""
    import numpy as np

    x = np.ascontiguousarray(x)
    x = x.view(f"u{x.dtype.itemsize}")
    return b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).data for k in range(x.dtype.itemsize))


def from_planes(raw, kind):
    """The numbers of such bytes."""
    import numpy as np

    size = np.dtype(kind).itemsize
    rows = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = rows[0].astype(f"u{size}")
    for k in range(1, size):
        out |= rows[k].astype(out.dtype) << out.dtype.type(8 * k)
    return out.view(kind)


def bundle(*arrays) -> bytes:
    """Number arrays as compressed bytes, bytes of equal weight together."""
    import struct

    import zstandard

    parts = []
    for x in arrays:
        parts += [struct.pack("<cBQ", x.dtype.kind.encode(), x.dtype.itemsize, len(x)), planes(x)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unbundle(data: bytes) -> list:
    import struct

    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, size, n = struct.unpack_from("<cBQ", raw, at)
        at += 10
        out.append(from_planes(memoryview(raw)[at : at + n * size], f"{kind.decode()}{size}"))
        at += n * size
    return out


def numbers(ids: list) -> tuple:
    """Ids that may be null as two arrays, for ``bundle``."""
    import numpy as np

    return np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8)


def nullable(values, null):
    import pyarrow as pa

    return pa.array(values, pa.int64(), mask=null.astype(bool))


def pack(docs: DataFrame, *extra: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, payload``: doc_id, text and extra columns in compressed Arrow streams; a block's number is the hash of its payload."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        out = pa.schema([("block", pa.int64()), ("payload", pa.binary())])

        def block(parts):
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(parts).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as stream:
                stream.write_table(whole)
            payload = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(payload) - (1 << 63)], pa.int64()), pa.array([payload], pa.binary())], schema=out)

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts.append(part := batch.slice(at, 256))
                held += part.get_total_buffer_size() if batch.num_rows <= 256 else sum(len(t or "") for t in part.column(1).to_pylist())
                if held >= block_bytes:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra).mapInArrow(run, "block bigint, payload binary")


def unpack(payload) -> list[list]:
    """The columns of a block; a null text is empty."""
    import pyarrow as pa

    columns = [c.to_pylist() for c in pa.ipc.open_stream(payload).read_all().columns]
    columns[1] = [t or "" for t in columns[1]]
    return columns


def squeeze(values) -> bytes:
    """Non-decreasing or small unsigned numbers as compressed differences, bytes of equal weight together."""
    import numpy as np
    import zstandard

    d = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(planes(d))


def stretch(data: bytes):
    import numpy as np
    import zstandard

    return np.cumsum(from_planes(zstandard.ZstdDecompressor().decompress(data), np.uint64), dtype=np.uint64)


def added(parts: list[bytes], held: list[bytes]) -> list[bytes]:
    """For each request to a bucket (hashes and a number for each) the sums of all requests' numbers for its hashes."""
    import numpy as np

    hashes, numbers = [stretch(x) for x in parts], [stretch(x) for x in held]
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order][1:] != flat[order][:-1]
    total = np.empty(len(flat), np.uint64)
    if len(flat):
        total[order] = np.add.reduceat(np.concatenate(numbers)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return [squeeze(x) for x in np.split(total, ends)]
