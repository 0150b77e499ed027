"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import byte_bpe, conversations, embedding_dedup, licenses, mixing, ngram_join, oracles, packing, pii, quality, runs, sharding, substrings, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (mixing.op1_source_mix, licenses.op2_license_scan, quality.op3_quality_scores, pii.op4_surrogates, substrings.op5_repeated_windows, ngram_join.op6_shingle_join, topk.op7_inner_products, packing.op8_length_buckets, sharding.op9_byte_shards, embedding_dedup.op10_near_vectors, runs.op11_periodic_runs, conversations.op12_conversation_repair, byte_bpe.op13_byte_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
