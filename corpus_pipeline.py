"""A training corpus from documents: good texts, one of each group of near copies, no personal data, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import numbered, saved, table, without_ids
from folioflow.llm.mixing import mix_sources
from folioflow.llm.ngram_join import shingle_components
from folioflow.llm.packing import pack, word_count
from folioflow.llm.pii import PUBLIC_KEY, replace_entities
from folioflow.llm.quality import fit_quality, with_score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEPT = ("lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, keep=COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, similarity 0.8) the row with the smallest id."""
    rows, _, given = numbered(docs, "doc_id", "text", KEPT)
    groups = shingle_components(rows, size=5, percent=80)
    others = groups.where("component != id").select("id")
    return given(without_ids(rows, others, "id"), id="doc_id").select(*COLUMNS)


def surrogates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with surrogates for personal data and secrets."""
    return replace_entities(docs.select(*COLUMNS), PUBLIC_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    rows, _, given = numbered(docs, "doc_id", "text", KEPT)
    copies = mix_sources(rows.select("id", "source", word_count().alias("size")), id_col="id").where("copies > 0")
    taken = rows.join(copies.select(F.col("doc_id").alias("id"), "copies"), "id")
    return given(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), id="doc_id").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every copy."""
    return pack(docs.select("doc_id", word_count().alias("n_tokens")), "n_tokens")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("PII surrogates", surrogates_stage),
    ("source mixing", mixing_stage),
    ("length-bucket packing", packing_stage),
]

#: SQL can't express the first stage, nor the search of the fourth; tests/llm hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each writes its table and the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
