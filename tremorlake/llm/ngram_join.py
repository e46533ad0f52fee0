"""N-gram Jaccard join: which documents' sets of word shingles overlap by 75 % or more, and their components.

1. Documents are packed into blocks; every block asks once for each of its distinct shingles, bucket by
   bucket, in how many block-wise distinct sets it occurs (equal sets of a block count once), and says how
   many of its own hold it. So a line that a third of all documents hold costs one request per block. Only
   32 bits of a shingle's hash travel beside its bucket: a collision can only make a unique shingle look shared.
2. A set less than 75 % of whose shingles are shared cannot link with another set and goes no further
   (most do). The others keep their shared shingles, rarest first - a global order, so two sets that link
   share one of the first n - ceil(0.75 n) + 1 of their order (prefix filter). The components of "share
   a prefix shingle" are clusters; no link leaves a cluster.
3. In a cluster, T-occurrence searches over inverted lists find the links: for a query set the T - 1 or
   fewer longest lists are set aside, the short ones merged by counting, and only sets that occur often
   enough there are probed by binary search in the long lists (DivideSkip); the exact test
   100 * overlap >= 75 * union follows. A cluster of at most ``SLICE`` sets is one search. A larger one is
   cut into slices: all its sets query its most central set, then all query those that didn't link with
   it, in blocks of ``SLICE``. Two sets that both link with the centre are in one component already, so
   no link that matters for components is lost, and no task or table grows with the square of a group of
   near copies.

Equal sets are one node throughout (the hash of the sorted set). Defined edge cases: a null or empty text,
or one without words, has an empty set, links with nothing and is its own component; fewer than five words
make one shingle; repeated rows share a component; a row without doc_id links like any other, but names a component
only where all of it have none (then null), and one_of_each keeps it only then; a very long text is one set; other
columns are ignored (or kept, by one_of_each), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import added, bucket_count, pack, squeeze, stretch, unpack
from .common import WordHash, fresh, mix, release, stage, table, window_hashes
from .components import connected_components

WIDTH = 5
PERCENT = 75
SLICE = 512
#: A search over so many bytes gives its memory back at once; Python workers outlive it.
RELEASED = 1 << 20


def shingle_set(text: str, hashed: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    h = hashed.of(text.encode().lower().split())
    if 0 < len(h) < WIDTH:
        out = mix(np.array([len(h)], np.uint64))
        for w in h:
            out = mix(out + w)
        return out
    return np.unique(window_hashes(h, WIDTH))


def set_node(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def need(n: int) -> int:
    """The smallest overlap that a set of n shingles has with any set it links with."""
    return -(-PERCENT * n // 100)


def block_sets(payload, hashed: WordHash):
    """The ids and marks of a block's documents, their sets and nodes, and the distinct non-empty sets by node."""
    ids, texts, marks = unpack(payload)
    sets = [shingle_set(t, hashed) for t in texts]
    nodes = [set_node(s) for s in sets]
    return ids, marks, sets, nodes, {n: s for n, s in zip(nodes, sets) if len(s)}


def asked(distinct: dict[int, np.ndarray], buckets: int):
    """The distinct shingles of a block by bucket, ascending, as their hashes' low 32 bits, and how many of its sets hold each.

    The first value is the place of each set's shingles among them, which puts answers back.
    """
    flat = np.concatenate([*distinct.values(), np.empty(0, np.uint64)])
    key = ((mix(flat) >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
    key, place, counts = np.unique(key, return_inverse=True, return_counts=True)
    bucket = (key >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    if not len(key):
        return place, [], [], []
    return place, bucket[edges].tolist(), np.split(key & np.uint64(0xFFFFFFFF), edges[1:]), np.split(counts, edges[1:])


def shared_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, mark, n_shingles, node`` of all documents; ``node, n, shared`` of the sets that may link, shared shingles rarest first)."""
    buckets = bucket_count(docs)
    blocks = pack(docs.withColumn("mark", F.xxhash64("text")), "mark").repartition("block")

    def ask(batches):
        import pyarrow as pa

        hashed = WordHash()
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, names, parts, held = asked(block_sets(payload.as_buffer(), hashed)[4], buckets)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(names, pa.int32()), "block": pa.array([number] * len(names), pa.int64()), "hashes": pa.array([squeeze(p) for p in parts], pa.binary()), "held": pa.array([squeeze(h) for h in held], pa.binary())})
        release()

    def answer(requests):
        import pyarrow as pa

        out = added(*(requests.column(c).to_pylist() for c in ("hashes", "held")))
        release()
        return pa.table({"block": requests.column("block"), "bucket": requests.column("bucket"), "counts": pa.array(out, pa.binary())})

    def assemble(packed, answers):
        import pyarrow as pa

        hashed = WordHash()
        replies = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
        rows = []
        for payload in packed.column("payload"):
            ids, marks, sets, nodes, distinct = block_sets(payload.as_buffer(), hashed)
            place, names, _, _ = asked(distinct, buckets)
            counts = np.concatenate([np.empty(0, np.uint64), *(stretch(replies[b]) for b in names)]).astype(np.int64)[place]
            at, shared = 0, {}
            for node, s in distinct.items():
                c = counts[at : at + len(s)]
                at += len(s)
                if (c > 1).sum() >= need(len(s)):
                    by = np.lexsort((s, c))
                    shared[node] = s[by[(c[by] > 1)]].view(np.int64)
            rows += [(i, m, len(s), n, shared.pop(n, None)) for i, m, s, n in zip(ids, marks, sets, nodes)]  # each set once
            del ids, marks, sets, nodes, distinct, place, counts
        release()
        return pa.table({n: pa.array(c, t) for n, t, c in zip(("doc_id", "mark", "n_shingles", "node", "shared"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), zip(*rows))})

    answers = blocks.mapInArrow(ask, "bucket int, block bigint, hashes binary, held binary").groupBy("bucket").applyInArrow(answer, "block bigint, bucket int, counts binary")
    rows = stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, "doc_id bigint, mark bigint, n_shingles bigint, node bigint, shared array<bigint>"), "sets")
    held = rows.where("shared is not null")
    first = held.groupBy(F.col("node").alias("_node")).agg(F.min("doc_id").alias("_first"))  # equal sets of several blocks: one row
    same = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    sets = held.join(first, same).dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), "shared")
    return rows.select("doc_id", "mark", "n_shingles", "node"), sets


class Lists:
    """Inverted lists of a block of sets, and T-occurrence queries."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes = sizes
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((owner, flat))
        self.keys, starts = np.unique(flat[order], return_index=True)
        self.owner, self.starts = owner[order], np.append(starts, len(flat))

    def query(self, n: int, s: np.ndarray) -> np.ndarray:
        """The sets of the block whose Jaccard similarity with a set of n shingles is high enough."""
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        at = at[self.keys[at] == s]
        t = need(n)
        if len(at) < t:
            return at[:0]
        lengths = self.starts[at + 1] - self.starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(t - 1, int(t / (0.01 * math.log2(lengths.max() + 1) + 1))) if lengths.max() > 8 else 0
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        counts = np.bincount(np.concatenate([self.owner[self.starts[i] : self.starts[i + 1]] for i in short]), minlength=len(self.sizes))
        fits = (100 * self.sizes >= PERCENT * n) & (100 * n >= PERCENT * self.sizes)
        candidates = np.flatnonzero(fits & (counts >= t - aside))
        overlap = counts[candidates]
        for left, i in zip(range(len(long), 0, -1), long):
            if not len(candidates):
                break
            part = self.owner[self.starts[i] : self.starts[i + 1]]
            p = np.minimum(np.searchsorted(part, candidates), len(part) - 1)
            overlap = overlap + (part[p] == candidates)
            able = overlap + left - 1 >= t
            if not able.all():
                candidates, overlap = candidates[able], overlap[able]
        return candidates[100 * overlap >= PERCENT * (n + self.sizes[candidates] - overlap)]


def search(group):
    """Links of a group's queries (role 0 or 2) with its index (role 1 or 2), as a star per component and the number of links."""
    import pyarrow as pa

    nodes, sizes, roles = (np.array(group.column(c).to_pylist(), np.int64) for c in ("node", "n", "role"))
    sets = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) for x in group.column("shared")]
    index, queries = np.flatnonzero(roles > 0), np.flatnonzero(roles != 1)
    parent = {int(n): int(n) for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(index) and len(queries):
        lists = Lists(sizes[index], [sets[i] for i in index])
        for q in queries:
            for i in index[lists.query(int(sizes[q]), sets[q])]:
                a, b = find(int(nodes[q])), find(int(nodes[i]))
                parent[max(a, b)] = min(a, b)
        del lists
    large = group.nbytes >= RELEASED
    del sets
    if large:
        release()
    stars = [(n, find(n)) for n in parent]
    stars = [(a, b) for a, b in stars if a != b]
    return pa.table({"a": pa.array([a for a, _ in stars], pa.int64()), "b": pa.array([b for _, b in stars], pa.int64())})


def links(sets: DataFrame) -> DataFrame:
    """``a, b``: edges between nodes whose components are those of all links."""
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(PERCENT) / 100) + 1 - (F.col("n") - F.size("shared"))
    places = sets.select("node", F.explode(F.slice("shared", F.lit(1), F.greatest(prefix, F.lit(1)).cast("int"))).alias("h"))
    heads = places.groupBy("h").agg(F.min("node").alias("head"))
    clusters = connected_components(places.join(heads, "h").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size")
    members = stage(sets.join(sized, "node"), "members")
    schema = "a bigint, b bigint"

    small = members.where(F.col("size") <= SLICE).select("root", "node", "n", "shared", F.lit(2).alias("role"))
    edges = stage(small.groupBy("root").applyInArrow(search, schema), "links")

    large = members.where(F.col("size") > SLICE)
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    queries = large.select("root", "node", "n", "shared", F.lit(0).alias("role"), F.pmod(F.xxhash64("node"), slices).cast("int").alias("slice"))

    def against(index: DataFrame, blocks: DataFrame | None) -> DataFrame:
        """All sets of the large clusters against some of theirs, which go to every slice."""
        spread = index.select("root", "node", "n", "shared", F.lit(1).alias("role"), "part", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
        asking = queries.withColumn("part", F.lit(0)) if blocks is None else queries.join(blocks, "root").select(*queries.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = asking.select("root", "slice", "part", "node", "n", "shared", "role").unionByName(spread.select("root", "slice", "part", "node", "n", "shared", "role"))
        return both.groupBy("root", "slice", "part").applyInArrow(search, schema)

    if large.limit(1).count():
        # the most central set: that with the most shared shingles for its size
        centre = large.groupBy("root").agg(F.max(F.struct((F.size("shared") / F.col("n")).alias("_share"), "node")).alias("m")).select("root", F.col("m.node").alias("node"))
        centres = stage(centre, "centres")
        first = stage(against(large.join(centres, ["root", "node"]).withColumn("part", F.lit(0)), None), "links")
        linked = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
        rest = stage(large.select("node", "root", "size").join(linked, "node", "left_anti"), "rest")
        parts = rest.groupBy("root").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("parts"))
        index = large.join(rest.select("node").join(centres.select("node"), "node", "left_anti"), "node").join(parts, "root")
        second = stage(against(index.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")), parts), "links")
        edges = edges.unionByName(first).unionByName(second)
    return edges


def ngram_components(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, root`` of every document; ``mark`` is xxhash64 of the text, ``root`` the component's node."""
    keys, sets = shared_sets(docs)
    sets = stage(sets, "candidates")
    roots = connected_components(links(sets))
    nodes = keys.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    nodes = stage(nodes, "nodes")
    least = stage(nodes.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # a plain join follows, whose hot roots Spark can split
    component = nodes.join(least, "root").select("node", "component_id", "root")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return keys.join(component, "node", "left").select("doc_id", "mark", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id (null comes last), with all its columns; every document without a word stays."""
    word = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    i, m, at = fresh(docs, "_id", "_mark", "_at")
    kept = ngram_components(docs).where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias(i), F.col("k.mark").alias(m))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(at) == F.col(m))
    return docs.withColumn(at, F.xxhash64("text")).where(word).join(kept, same, "left_semi").dropDuplicates(["doc_id", at]).drop(at).unionByName(docs.where(~word))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
), m AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
