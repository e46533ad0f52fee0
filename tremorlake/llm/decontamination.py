"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

Every benchmark item gives windows of ``WINDOW`` consecutive words (a shorter item is one window). One
aggregation over all documents counts the test terms; each window is anchored at its rarest term. The
index of the corpus is written to the shared folder: for each place of an anchor term its document, its
position and the terms at the adjusted offsets around it. Windows are joined to the postings of their
anchor, and the offset-adjusted terms are intersected: all equal is an exact phrase, at least
``NEAR_TERMS`` of ten is a proximity match (reported beside the exact ones).

Only the windows are broadcast, in blocks of at most ``BLOCK_WINDOWS`` windows and ``BLOCK_BYTES`` bytes;
a larger benchmark goes over the documents block by block. Documents are never shuffled, only the
postings of anchors and one short row per document are.

Defined edge cases: a null or empty text has no words and no window; a null item_id marks words but is no
listed item; repeated items count once; repeated documents each give a row; ``items_sha256`` of no item is
the digest of the empty string; empty tables give no windows or no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, stage, table

WINDOW = 10
NEAR_TERMS = 8
BLOCK_WINDOWS, BLOCK_BYTES = 200_000, 32 << 20
_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z only, then splits; ``lower`` does that for ASCII texts, ``translate`` for the others."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _SEPARATOR), "")


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, window, phrase`` for each distinct window of each item; ``window`` is its hash."""
    w = F.col("_words")
    return (
        items.select("item_id", words(F.col("text")).alias("_words"))
        .where(F.size(w) > 0)
        .select("item_id", "_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))).alias("_at"))
        .select("item_id", F.slice(w, F.col("_at") + 1, WINDOW).alias("phrase"))
        .distinct()
        .withColumn("window", F.xxhash64("phrase"))
    )


def anchored(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with their rarest term and its offset; a term's count is that of its places in all documents.

    A window of which so many terms occur nowhere that it can't even match in proximity goes.
    """
    places = windows.select("item_id", "window", "phrase", F.posexplode("phrase").alias("_off", "term"))
    terms = places.select("term").distinct()
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return (
        places.join(F.broadcast(counts), "term", "left")  # a row per term of the block at most
        .groupBy("item_id", "window", "phrase")
        .agg(F.min(F.when(F.col("n") > 0, F.struct("n", F.col("_off").alias("off"), "term"))).alias("_rare"), F.count("n").alias("_present"))
        .where((F.col("_present") == F.size("phrase")) | (F.col("_present") >= NEAR_TERMS))
        .select("item_id", "phrase", "_rare.off", "_rare.term")
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, doc_id, text_hash, pos, first, context``: the context is the words from position ``first`` to ``pos + WINDOW - 1``."""
    pos, first = F.col("pos"), F.col("first")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_words"))
        .select("doc_id", "text_hash", "_words", F.posexplode("_words").alias("pos", "term"))
        .join(F.broadcast(terms), "term")
        .withColumn("first", F.greatest(pos - (WINDOW - 1), F.lit(0)))
        .select("term", "doc_id", "text_hash", "pos", "first", F.slice("_words", first + 1, pos + WINDOW - first).alias("context"))
    )


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text_hash, item_id, start, stop, terms_matched, exact`` of every exact phrase and proximity match."""
    all_windows = stage(item_windows(items), "windows")
    n, size = all_windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "phrase"))), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_WINDOWS), -(-size // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        windows = all_windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == b) if blocks > 1 else all_windows
        rare = stage(anchored(docs, windows), "anchors")
        index = stage(postings(docs, rare.select("term").distinct()), "postings")
        start = F.col("pos") - F.col("off")
        here = F.slice("context", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("phrase"))  # Spark may slice before it filters by start
        equal = F.size(F.filter(F.zip_with(here, F.col("phrase"), lambda a, b: a == b), lambda x: x))
        part = (
            index.join(F.broadcast(rare), "term")
            .where(F.col("pos") >= F.col("off"))
            .select("doc_id", "text_hash", "item_id", start.alias("start"), (start + F.size("phrase")).alias("stop"), equal.alias("terms_matched"), (here == F.col("phrase")).alias("exact"))
            .where(F.col("exact") | (F.col("terms_matched") >= NEAR_TERMS))
        )
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: word and hit counts, exact items, and ``n_near``, the items with a proximity match only."""
    docs = docs.select("doc_id", "text")
    exact = F.col("exact")
    span = F.when(exact, F.struct(F.col("start"), F.col("stop")))
    hits = (
        matches(docs, items)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.array_sort(F.collect_set(span)).alias("_spans"),
            F.array_sort(F.collect_set(F.when(exact, F.col("item_id").cast("string")))).alias("_items"),
            F.collect_set(F.col("item_id").cast("string")).alias("_near"),
        )
        .withColumnRenamed("doc_id", "_doc_id")
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["upto"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
        lambda a: a["n"],
    )
    none = F.array().cast("array<string>")
    listed = F.coalesce("_items", none)
    n_hit = F.coalesce(covered, F.lit(0))
    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("n_words"))
        .join(hits, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_hash") == F.col("text_hash")), "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
            F.size(F.array_except(F.coalesce("_near", none), listed)).cast("bigint").alias("n_near"),
        )
    )


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an exact phrase of the benchmark, with all their columns."""
    i, m, at = fresh(docs, "_id", "_mark", "_at")
    hit = matches(docs.select("doc_id", "text"), items).where("exact").select(F.col("doc_id").alias(i), F.col("text_hash").alias(m)).distinct()
    return docs.withColumn(at, F.xxhash64("text")).join(hit, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(at) == F.col(m)), "left_anti").drop(at)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(p) AS size, array_to_string(p, ' ') AS phrase
  FROM (SELECT item_id, w[i + 1 : i + 10] AS p FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0))
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, i, size, array_to_string(w[i + 1 : i + size], ' ') AS phrase
  FROM (SELECT rid, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)
), m AS (
  SELECT dw.rid, bw.item_id, dw.i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.phrase = bw.phrase
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM m) GROUP BY rid
), k AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN k USING (rid)
"""
