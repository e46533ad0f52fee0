"""What several operators share: tables, staging in the shared folder, byte-level words, bounded label samples."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts per Arrow batch; long texts come a few at a time.
BATCH_BYTES = 16 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a space.
ALNUM_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` or, where that setting is absent, in the session's checkpoint folder.

    Only a local master, whose tasks share the driver's disk, may have neither (tests): it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tremorlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tremorlake-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more removed now; else they stay until the driver happens to collect its garbage."""
    import gc
    import time

    for _ in range(2):  # what the first round frees may be what held on to others
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # files are removed beside it


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``mod``; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_rest(doc_id, mod: int) -> int:
    """``crc_mod`` inside a task."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


#: At most so many bytes of sample texts of either label reach the driver.
SAMPLE_BYTES = 64 << 20


def labelled_rows(docs: DataFrame, labels: DataFrame, target: str, per_class: int, held: tuple[int, int] | None) -> list[tuple[int, str, int]]:
    """Id, text and label of at most ``per_class`` training rows of either label, chosen by the smallest hash of their id.

    ``held`` is (modulus, remainder) of the held-out rows. The bound holds for what is broadcast
    (2 * per_class ids) and for what reaches the driver: the ids and lengths of as many texts, and for either label
    whole texts of ``SAMPLE_BYTES`` at most. Texts are taken in the order of their ids' hashes; one that doesn't fit into what is left is
    passed over, and those after it are still taken. Ids with a null id or label give nothing; an id labelled twice takes its larger
    label; of an id that the table repeats the smallest text counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    if held:
        rows = rows.where(crc_mod(F.col("doc_id"), held[0]) != held[1])
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = stage(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y").agg(F.min("_text").alias("_text")), "labelled"
    )
    left, taken = {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}, []
    for i, y, size in texts.select("doc_id", "_y", F.octet_length("_text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if size <= left[y]:
            left[y] -= size
            taken.append((i,))
    keep = docs.sparkSession.createDataFrame(taken, docs.select("doc_id").schema)
    got = texts.join(F.broadcast(keep), "doc_id").select("doc_id", "_text", "_y").collect()
    return sorted(((i, t, y) for i, t, y in got), key=lambda r: r[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, held: tuple[int, int] | None) -> list[tuple[str, int]]:
    return [(text, y) for _, text, y in labelled_rows(docs, labels, target, per_class, held)]


def alnum_words(text: str) -> list[bytes]:
    return text.encode().translate(ALNUM_TABLE).split()


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of a bounded vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total.update(shared.value.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})
        release()

    rows = small_batches(docs).select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist()))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weights: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Newton's method for a logistic regression with few columns; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    s = np.ones(len(x)) if weights is None else weights
    ridge = np.full(x.shape[1], l2 * len(x))
    ridge[-1] = 1e-9 * max(len(x), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (s * (p - y)) + ridge * w
        hess = (x * (s * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def class_counts(labels: DataFrame, target: str, held: tuple[int, int] | None) -> tuple[int, int]:
    """Labelled training ids with label 0 and with label 1 (no texts are read)."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_y"))
    if held:
        rows = rows.where(crc_mod(F.col("doc_id"), held[0]) != held[1])
    got = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    return got.get(0, 0), got.get(1, 0)


class WordHash(dict):
    """64-bit hashes of words, remembered for at most ``bound`` words."""

    bound = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """xxh64 of the words of all texts (A-Z in lower case, split at ASCII blanks), and how many words each text has.

    The values are those of ``WordHash.of(text.encode().lower().split())``, but words of one length are hashed together.
    """
    import xxhash

    data = [t.encode().lower() for t in texts]
    ends = np.cumsum([len(x) + 1 for x in data])
    joined = b" ".join([*data, b"       "])  # a blank behind each text, and room to read eight bytes from any place
    del data
    raw = np.frombuffer(joined, np.uint8)
    edge = np.diff(_BLANK[raw].view(np.int8), prepend=np.int8(1))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    del edge
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    size = stop - start
    out = np.empty(len(start), np.uint64)
    # eight and four bytes from every place on
    eight = np.ndarray((max(0, len(raw) - 7),), "<u8", joined, strides=(1,))
    four = np.ndarray((max(0, len(raw) - 3),), "<u4", joined, strides=(1,))
    order = np.argsort(np.minimum(size, 32).astype(np.int8), kind="stable")
    for which in np.split(order, np.flatnonzero(np.diff(np.minimum(size, 32)[order])) + 1) if len(order) else []:
        at, n = start[which], int(size[which[0]])
        if n >= 32:
            out[which] = [xxhash.xxh64_intdigest(joined[a : a + s]) for a, s in zip(at.tolist(), size[which].tolist())]
            continue
        h, done = np.full(len(at), (int(_P5) + n) & 0xFFFFFFFFFFFFFFFF, np.uint64), 0
        while n - done >= 8:
            h = _turned(h ^ _turned(eight[at + done] * _P2, 31) * _P1, 27) * _P1 + _P4
            done += 8
        if n - done >= 4:
            h = _turned(h ^ four[at + done].astype(np.uint64) * _P1, 23) * _P2 + _P3
            done += 4
        for k in range(done, n):
            h = _turned(h ^ raw[at + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        out[which] = h ^ h >> np.uint64(32)
    return out, counts


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` neighbouring values; none when there are fewer."""
    m = len(h) - width + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = mix(h[:m])
    for i in range(1, width):
        out = mix(out + h[i : i + m])
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """The table; from now on its session sends at most ``BATCH_BYTES`` to a Python worker at once, unless it has a limit of its own."""
    if df.sparkSession.conf.get(_BATCH_LIMIT, None) is None:
        df.sparkSession.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df


def release() -> None:
    """Give memory that a finished task doesn't need any more back to the system; Python workers outlive tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(docs: DataFrame, make, schema: str, keep: str = "doc_id bigint", batches: bool = False) -> DataFrame:
    """One output row per document, whole texts in Arrow batches.

    ``make()`` runs once per task and returns a function from a text (null read as empty) to the tuple of
    the columns of ``schema``; with ``batches`` from a list of texts to such tuples.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"{keep}, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(parts):
        import pyarrow as pa

        fn = make()
        for batch in parts:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = list(fn(texts)) if batches else [fn(t) for t in texts]
                columns = [part.column(0), *([r[i] for r in rows] for i in range(len(arrow) - 1))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        release()

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, full)
