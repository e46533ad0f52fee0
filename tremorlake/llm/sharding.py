"""Operator 12: shards of near equal bytes, changed with the fewest bytes moved by a minimum-cost flow.

A layout is a folder of Parquet files, each with a run of one shard's rows in the order of (hash of the text, row number),
and one manifest a generation, which lists the live files with their shard, rows and bytes. ``reshard`` takes the sizes of the old shards and the
new capacities, solves the flow of bytes between them (cost 0 for what stays, 1 or a given price for what moves) and cuts each
sender's line of rows where the flow says: what stays first, then what each receiver gets. The keys at the cuts come from sums by
ranges of the hash, narrowed in a few passes. Files that a cut leaves whole in
their shard aren't touched; all others are read and written anew, and a new manifest makes the change visible at once. Files
of older generations stay until ``vacuum``.

What the driver sees: sizes of shards, paths and sums of files (one per ``FILE_BYTES``), and groups of equal texts that hold more than a
512th of a shard (at most 512 times as many as shards). Equal texts have one old shard and stay together: large groups stay where
they are, largest first, as far as their shard's part that stays has room; a cut that falls into a small group moves to the nearer of its
ends; only a group for which no shard has room is cut between its rows. So sizes differ by about a small group at most.

Defined edge cases: a null text has no bytes, so size 1, and is taken as equal to the empty text; rows without doc_id and repeated rows are rows like
others, numbered before the first write; very long texts are rows like others; an empty table gives a layout without
files and no rows; other columns, whatever their names, are kept inside one struct column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.selection import select
from .common import shared_dir, table

#: Bytes of texts per file of a layout; shards before and after the change that the query makes.
FILE_BYTES, OLD_SHARDS, SHARDS = 128 << 20, 12, 16
#: A group of equal texts of more than this share of the smallest new shard is placed as a whole before rows are.
LARGE_GROUP = 1 / 512
MANIFEST = "file string, block bigint, shard int, rows bigint, bytes bigint"


def transfers(sizes: list[int], capacities: list[int], prices: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old to each new shard that move everything at the least cost: a minimum-cost flow by shortest augmenting paths.

    ``prices[i, j]`` is the cost of a byte that goes from i to j; where it isn't given, a byte that stays (j = i) is free and
    any other costs 1. Capacities may leave room; they must hold all.
    """
    m, k = len(sizes), len(capacities)
    if sum(capacities) < sum(sizes):
        raise ValueError("the new shards have no room for all bytes")
    price = 1 - np.eye(m, k) if prices is None else np.asarray(prices, float)
    flow, supply, room = np.zeros((m, k), object), np.array(sizes, object), np.array(capacities, object)
    while (supply > 0).any():
        back = np.where((flow > 0).astype(bool), -price, np.inf)  # what flows can be taken back
        source, sink = np.where((supply > 0).astype(bool), 0.0, np.inf), np.full(k, np.inf)
        from_source, from_sink = np.zeros(k, int), np.full(m, -1)
        while True:
            reach = source[:, None] + price
            near = reach.min(axis=0)
            better = near < sink - 1e-9
            sink, from_source = np.where(better, near, sink), np.where(better, reach.argmin(axis=0), from_source)
            reach = sink[None, :] + back
            near = reach.min(axis=1)
            closer = near < source - 1e-9
            source, from_sink = np.where(closer, near, source), np.where(closer, reach.argmin(axis=1), from_sink)
            if not closer.any():
                break
        j = int(np.where((room > 0).astype(bool), sink, np.inf).argmin())
        path, at = [], j
        while True:
            i = int(from_source[at])
            path.append((i, at, 1))
            if from_sink[i] < 0:
                break
            at = int(from_sink[i])
            path.append((i, at, -1))
        amount = min([supply[i], room[j], *(flow[a, b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a, b] += sign * amount
        supply[i] -= amount
        room[j] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Layout:
    """One generation of a layout. ``rows()`` has row (a struct of the documents' columns), size, text_hash, uid, block, shard."""

    spark: SparkSession
    path: str
    generation: int
    manifest: DataFrame
    schema: object

    def files(self) -> list[str]:
        return [r[0] for r in self.manifest.select("file").collect()]

    def rows(self, files: list[str] | None = None) -> DataFrame:
        files = self.files() if files is None else files
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def sizes(self) -> dict[int, int]:
        return {r[0]: r[1] for r in self.manifest.groupBy("shard").agg(F.sum("bytes")).collect()}

    def numbered(self) -> DataFrame:
        """``rows()`` with ``slot``, the place of a row in its shard: the rows of the shard's files before plus the place in the file."""
        w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # of one row per file
        before = self.manifest.select(F.col("block").alias("_block"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("_before"))
        if not self.files():
            return self.rows().withColumn("slot", F.lit(0).cast("bigint"))
        placed = self.rows().withColumn("_at", F.col("_metadata.row_index"))
        return placed.join(before, F.col("block") == F.col("_block")).withColumn("slot", F.col("_before") + F.col("_at")).drop("_at", "_block", "_before")


def _written(layout: Layout, rows: DataFrame, generation: int) -> DataFrame:
    """Write rows with their new ``shard`` as files of a generation; ``MANIFEST`` rows of these files."""
    base = generation << 40
    marked = rows.withColumn("block", (F.spark_partition_id() + F.lit(base)).cast("bigint"))
    path = f"{layout.path}/data-{generation}"
    numbered = marked.withColumn("block", F.col("block") * 4096 + F.col("shard")).withColumn("folder", F.col("shard"))  # a task writes a file per shard
    numbered.write.option("maxRecordsPerFile", 0).option("compression", "zstd").partitionBy("folder").parquet(path)
    found = layout.spark.read.schema(layout.schema).parquet(path)
    return found.groupBy(F.col("_metadata.file_path").alias("file"), "block", "shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _committed(layout: Layout, manifest: DataFrame, generation: int) -> Layout:
    path = f"{layout.path}/manifest-{generation}"
    manifest.select("file", "block", "shard", "rows", "bytes").write.parquet(path)
    return Layout(layout.spark, layout.path, generation, layout.spark.read.schema(MANIFEST).parquet(path), layout.schema)


def lay_out(docs: DataFrame, path: str, shards: int, shard: Column | None = None, text: str = "text", file_bytes: int = FILE_BYTES) -> Layout:
    """Write documents as generation 0; a row's shard is its text's hash modulo ``shards`` or the given column of the documents."""
    if not 0 < shards <= 4096:
        raise ValueError("a layout has 1 to 4096 shards")
    spark, whole_text = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    hashed = F.shiftrightunsigned(F.xxhash64(whole_text), 11)  # 53 bits, which doubles hold
    place = F.pmod(hashed, F.lit(shards)).cast("int") if shard is None else shard.cast("int")
    size = (F.octet_length(whole_text) + F.lit(1)).cast("bigint")
    rows = docs.select(F.struct(*docs.columns).alias("row"), size.alias("size"), hashed.alias("text_hash"), F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("bigint").alias("block"), place.alias("shard"))
    schema = spark.createDataFrame([], rows.schema).schema
    total = docs.agg(F.sum(size)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    order = ["shard", "text_hash", "uid"]  # the last is a row's own, so no key is too large for a file
    empty = Layout(spark, path, 0, None, schema)
    return _committed(empty, _written(empty, rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), 0), 0)


def open_layout(spark: SparkSession, path: str, generation: int, schema) -> Layout:
    return Layout(spark, path, generation, spark.read.schema(MANIFEST).parquet(f"{path}/manifest-{generation}"), schema)


def _up_to(key: tuple[int, int]) -> Column:
    """Rows whose (hash, row number) is not beyond a key."""
    return (F.col("text_hash") < F.lit(key[0])) | ((F.col("text_hash") == F.lit(key[0])) & (F.col("uid") <= F.lit(key[1])))


def _cut_keys(line: DataFrame, cuts: dict[int, list[int]], small: float) -> dict[tuple[int, int], tuple[int, int]]:
    """For each (shard, cut in bytes) the key of the last row before it on the shard's ``line``; no task holds a shard.

    A cut inside a group of equal texts of at most ``small`` bytes goes to the nearer end of the group, else to the nearer end of a row.
    """
    spark, keys, within = line.sparkSession, {}, []
    wanted = spark.createDataFrame([(s, c) for s, at in cuts.items() for c in at], "shard int, rank bigint")
    for s, cut, h, before, group in select(line, ["shard"], "text_hash", wanted, "size").select("shard", "rank", "value", "before", "own").collect():
        if group <= small:
            keys[s, cut] = (int(h), 2**53 if before + group - cut <= cut - before else -1)
        else:
            within.append((s, int(h), cut - before, cut))
    if within:
        groups = spark.createDataFrame(within, "shard int, text_hash bigint, rank bigint, cut bigint")
        rows = line.join(F.broadcast(groups.select("shard", "text_hash").distinct()), ["shard", "text_hash"])
        for s, cut, h, rank, uid, before, size in select(rows, ["shard", "text_hash"], "uid", groups, "size").join(groups, ["shard", "text_hash", "rank"]).select("shard", "cut", "text_hash", "rank", "value", "before", "own").collect():
            keys[s, cut] = (h, int(uid) if before + size - rank <= rank - before else int(uid) - 1)
    return keys


def reshard(layout: Layout, capacities: list[int], prices: np.ndarray | None = None) -> Layout:
    """The next generation: each new shard holds about as many bytes as it has capacity for, and as few as possible are moved."""
    spark, held = layout.spark, layout.sizes()
    old = max(held, default=-1) + 1
    flow = transfers([held.get(i, 0) for i in range(old)], capacities, prices)
    senders = [i for i in range(old) if any(flow[i, j] for j in range(len(capacities)) if j != i)]
    generation = layout.generation + 1
    if not senders:
        return _committed(layout, layout.manifest, generation)
    files = [r[0] for r in layout.manifest.where(F.col("shard").isin(senders)).select("file").collect()]
    rows = layout.rows(files)
    small = LARGE_GROUP * min((c for c in capacities if c), default=0)
    large = rows.groupBy("shard", "text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > small).collect()
    stay = {i: flow[i, i] if i < len(capacities) else 0 for i in senders}
    pinned = []
    for s, h, size in sorted(large, key=lambda r: (-r[2], r[0], r[1])):
        if size <= stay[s]:
            stay[s] -= size
            pinned.append((s, h))
    held_back = F.broadcast(spark.createDataFrame(pinned, "shard int, text_hash bigint"))
    line = rows.join(held_back, ["shard", "text_hash"], "left_anti")
    cuts, ways = {}, {}
    for i in senders:
        at = stay[i]
        cuts[i], ways[i] = [at], [i]
        for j in range(len(capacities)):
            if j != i and flow[i, j]:
                at += flow[i, j]
                cuts[i].append(at)
                ways[i].append(j)
        cuts[i].pop()  # the last receiver takes the rest of the line
    keys = _cut_keys(line.select("shard", "text_hash", "uid", "size"), {i: [c for c in at if c > 0] for i, at in cuts.items()}, small)
    target = F.col("shard")
    for i in senders:
        own = F.lit(ways[i][-1])
        for c, way in reversed(list(zip(cuts[i], ways[i]))):
            own = F.when(_up_to(keys[i, c]), way).otherwise(own) if c > 0 else own
        target = F.when(F.col("shard") == i, own).otherwise(target)
    marked = rows.join(held_back.withColumn("_held", F.lit(True)), ["shard", "text_hash"], "left").withColumn("_to", F.when(F.col("_held"), F.col("shard")).otherwise(target))
    moved = marked.groupBy("block").agg(F.count_if(F.col("_to") != F.col("shard")).alias("moved")).where("moved > 0").select("block")
    affected = [r[0] for r in layout.manifest.join(moved, "block").select("file").collect()]
    kept = layout.manifest.join(spark.createDataFrame([(f,) for f in affected], "file string"), "file", "left_anti")
    if not affected:
        return _committed(layout, kept, generation)
    again = layout.rows(affected).join(held_back.withColumn("_held", F.lit(True)), ["shard", "text_hash"], "left")
    again = again.withColumn("shard", F.when(F.col("_held"), F.col("shard")).otherwise(target)).select(*[f.name for f in layout.schema])
    return _committed(layout, kept.unionByName(_written(layout, again, generation)), generation)


def vacuum(layout: Layout) -> int:
    """Delete the files of the layout's folder that its generation doesn't list; how many there were."""
    jvm, live = layout.spark._jvm, {f.split(":", 1)[-1].lstrip("/") for f in layout.files()}
    top = jvm.org.apache.hadoop.fs.Path(layout.path)
    fs, dead = top.getFileSystem(layout.spark._jsc.hadoopConfiguration()), []
    walk = fs.listFiles(top, True)
    while walk.hasNext():
        at = walk.next().getPath()
        if "/data-" in at.toString() and at.getName().endswith(".parquet") and at.toString().split(":", 1)[-1].lstrip("/") not in live:
            dead.append(at)
    return sum(bool(fs.delete(at, False)) for at in dead)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = lay_out(docs, f"{shared_dir(spark)}-shards", OLD_SHARDS)
    after = reshard(before, equal_capacities(sum(before.sizes().values()), SHARDS))
    rows = after.numbered()
    text = F.coalesce("row.text", F.lit("")).cast("binary")
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
