"""WARC archives as a Spark data source.

``df.write.format("tremorlake_warc").save(dir)`` writes one gzip archive per task, each record a gzip
member of its own; ``spark.read.format("tremorlake_warc").load(dir)`` plans one partition per archive.
The length of a compressed member stands in the ``sl`` extra field of its gzip header, so a reader
that doesn't want a record's payload steps over it: equality and IN predicates on ``record_type``,
``page_id``, ``url``, ``payload_digest`` and ``refers_to`` are pushed down, headers are inflated and
parsed first, and only a wanted record's payload is decoded (never, when ``payload`` is not asked for
by the option ``payload=false``). Archives of other writers are read too, one record a gzip member: such a
member is inflated to find its end, its ids are null and its payload is decoded as UTF-8 with replacements.
A member that is cut off, isn't gzip or has a wrong checksum is an error that names the file and the place.

Defined edge cases: a null html is the empty payload; a null url or page_id is left out of the headers
and read back as null; repeated rows are written once each; an empty table gives an empty archive
folder and no rows; other columns of the input are not written.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from .common import shared_dir, table

FORMAT = "tremorlake_warc"
SCHEMA = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload string"
#: Shorter payloads are never written as revisits.
MIN_REVISIT_BYTES = 100
#: How many copies the first-holder rows of a payload get, so that one hot payload spreads over tasks.
SALTS = 16
_PUSHED = ("record_type", "page_id", "url", "payload_digest", "refers_to")
_GZIP = b"\x1f\x8b\x08"
#: How the extra field of a gzip header begins: its length, its name, the length of its two numbers.
_MARK = b"\x0c\0sl\x08\0"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def member(data: bytes, head_bytes: int) -> bytes:
    """A gzip member whose extra field holds its own length and the length of the part with the headers.

    The headers end at a full flush, so they can be inflated alone.
    """
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    head = deflate.compress(data[:head_bytes]) + deflate.flush(zlib.Z_FULL_FLUSH)
    body = head + deflate.compress(data[head_bytes:]) + deflate.flush()
    extra = _MARK + struct.pack("<II", 24 + len(body) + 8, len(head))
    return _GZIP + b"\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url, html, record_type: str, refers_to) -> bytes:
    payload = b"" if html is None else html.encode()
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    head = "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    return member(head + block[len(http):] + b"\r\n\r\n", len(head))


@dataclass
class _Written(WriterCommitMessage):
    name: str


@dataclass
class _Archive(InputPartition):
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"  # another name for each attempt
        rows = 0
        with fs.open_output_stream(f"{base}/.{name}", compression=None, buffer_size=1 << 20) as out:
            for batch in iterator:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to"))):
                    out.write(record(*row))
                    rows += 1
        if not rows:
            fs.delete_file(f"{base}/.{name}")
        return _Written(name if rows else "")

    def commit(self, messages):
        """Only what a successful attempt wrote gets its visible name."""
        fs, base = _filesystem(self.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            if m and m.name:
                fs.move(f"{base}/.{m.name}", f"{base}/{m.name}")

    def abort(self, messages):
        fs, base = _filesystem(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{base}/.{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _PUSHED and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, base = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return [_Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(".warc.gz") and not x.base_name.startswith(".")]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # Spark's way to read a folder without archives
            return
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        fs, _ = _filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file, io.BufferedReader(file, 1 << 20) as source:
            while (row := self._record(source, partition.path, file.size())) is not None:
                if not row:
                    continue
                rows.append(row)
                held += len(row["payload"] or "")
                if len(rows) >= 4096 or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _record(self, source, path: str, length: int) -> dict | None:
        """The row of the record at the reader's place, an empty one if a predicate refuses it, None at the end of the archive."""
        at = source.tell()
        start = source.read(24)
        if not start:
            return None
        if start[:3] != _GZIP:
            raise ValueError(f"{path}: no gzip member at byte {at}")
        if start[3:4] != b"\x04" or start[10:16] != _MARK:
            return self._unmarked(source, path, at)
        size, head_size = struct.unpack("<II", start[16:])
        if at + size > length:
            raise ValueError(f"{path}: the member at byte {at} is cut off")
        inflate = zlib.decompressobj(-15)
        head = inflate.decompress(source.read(head_size))
        row = _own_row(head)
        take = self._wants(row)
        if not (take and self.payload and row["record_type"] == "response"):
            source.seek(at + size)  # nothing of this payload is inflated
            return row if take else {}
        body = source.read(size - 24 - head_size)
        data = inflate.decompress(body[:-8])
        if zlib.crc32(data, zlib.crc32(head)) != struct.unpack("<I", body[-8:-4])[0]:
            raise ValueError(f"{path}: the checksum of the member at byte {at} is wrong")
        return row | {"payload": data[:-4].decode()}

    def _unmarked(self, source, path: str, at: int) -> dict:
        """A record of another writer, whose member must be inflated to find its end; zlib checks its checksum."""
        source.seek(at)
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            part = source.read(1 << 20)
            if not part:
                raise ValueError(f"{path}: the member at byte {at} is cut off")
            parts.append(inflate.decompress(part))
        source.seek(-len(inflate.unused_data), 1)
        top, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = _fields(top)
        block_size = int(fields.get("content-length", len(rest)))
        if rest[block_size:].strip(b"\r\n"):
            raise ValueError(f"{path}: the member at byte {at} holds several records; one a member is read")
        row, payload = _other_row(fields, rest[:block_size])
        if not self._wants(row):
            return {}
        return row | {"payload": payload.decode(errors="replace")} if self.payload and row["record_type"] == "response" else row

    def _wants(self, row: dict) -> bool:
        return all(row[c] in v for c, v in self.wanted.items())


def _fields(top: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = (line.partition(":") for line in top.decode(errors="replace").split("\r\n")[1:])
    return {name.lower(): value.removeprefix(" ") for name, _, value in lines}


def _own_row(head: bytes) -> dict:
    top, http, _ = head.split(b"\r\n\r\n")
    fields = _fields(top)
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    url = fields.get("warc-target-uri")
    return {
        "page_id": number(fields.get("warc-record-id")),
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["warc-type"],
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": None,
    }


def _other_row(fields: dict, block: bytes) -> tuple[dict, bytes]:
    """A record without our ids: its page_id and refers_to are null; the digest is that of its payload."""
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    row = {"page_id": None, "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "payload_bytes": len(payload)}
    return row | {"payload_digest": hashlib.sha256(payload).hexdigest(), "refers_to": None, "payload": None}, payload


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``: of equal payloads of ``MIN_REVISIT_BYTES`` or more, the smallest page_id holds the response.

    The smallest id of a payload is found over (digest, id) pairs with map-side aggregation; only digests
    held by several rows are joined back, salted, so neither a hot payload nor the html of all pages meets
    in a task. Rows that share the smallest page_id are all responses; a null page_id is the largest and
    a payload with no other id has responses only.
    """
    pages = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("_digest"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT_BYTES
    firsts = (
        pages.where(long)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1 and _first is not null")
        .select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return salted.join(firsts, ["_digest", "_salt"], "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    pages.sparkSession.dataSource.register(WarcDataSource)
    with_revisits(pages).write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every page through archives; digests and lengths are taken again from the decoded payloads.

    A revisit has no payload of its own, so its figures are those of its headers.
    """
    path = f"{shared_dir(spark)}-warc"
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path)
    response = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2(F.col("payload").cast("binary"), 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
), r AS (
  SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND (page_id IS NULL OR page_id <> first_id) AS again FROM g
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
