"""Queries of the training-data operators, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from . import bpe, compression_quality, decontamination, language_model, license_scan, ngram_join, quality_rules, sharding, substring_dedup, toxicity, vector_codes, warc, whitening

QUERIES = {
    "op1_compression": compression_quality.op1_compression,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_language_model": language_model.op4_language_model,
    "op5_warc": warc.op5_warc,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_license": license_scan.op8_license,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_sharding": sharding.op12_sharding,
    "op13_whitening": whitening.op13_whitening,
}
ORACLE_SQL = {"op5_warc": warc.OP5_SQL, "op7_ngram_join": ngram_join.OP7_SQL, "op10_decontamination": decontamination.OP10_SQL, "op11_vector_codes": vector_codes.OP11_SQL}
