"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

The stages, in order: toxic documents go; one document of each n-gram Jaccard component stays; passages
that an earlier document holds are cut out; documents with a benchmark phrase go; the rest is encoded by
byte-level BPE, decoded again and reported by digests. All but the last return the columns of ``documents``.

Defined edge cases, as the stages' own modules state them: a null or empty text is never toxic by itself (it gets the
examples' share of such texts), is no copy, has no passage and no phrase, and is encoded as no token; a null doc_id stays null; rows that
are repeated are one copy each and go in the second stage; very long texts are taken whole; extra columns of ``documents`` are kept by all
stages but the last; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremorlake.llm.bpe import digests
from tremorlake.llm.common import stage, table
from tremorlake.llm.decontamination import uncontaminated
from tremorlake.llm.ngram_join import one_of_each
from tremorlake.llm.substring_dedup import without_passages
from tremorlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("bpe", bpe)]
#: SQL can't express the stages; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
