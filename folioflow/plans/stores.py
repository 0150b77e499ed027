"""Registered queries that write to the shared folder and read back: chunks with snapshots, texts, the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.plans import ingest as ingest_plans
from folioflow.plans import tables
from folioflow.plans.ingest import document_chunks
from folioflow.plans.papers import papers
from folioflow.sources import analyses
from folioflow.sources.shared import shared_dir
from folioflow.sources.snapshots import SnapshotTable
from folioflow.streaming import ingest


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def snapshot_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks in a snapshot table; documents with an even id get theirs anew, those divisible by 4 none; then the
    table is compacted and read. The same rows as `replaced_chunks`."""
    table = SnapshotTable(spark, _folder(spark, "chunk-table"), buckets=4)
    chunks = document_chunks(spark, sf_dir).select("document_id", "chunk_index", "text")
    owners = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    table.replace(chunks, owners)
    touched = owners.where("document_id % 2 = 0 and document_id > 0")
    again = chunks.where("document_id % 2 = 0 and document_id > 0 and document_id % 4 != 0").withColumn("text", F.concat(F.lit("new "), "text"))
    table.replace(again, touched)
    table.compact(most=1)
    return table.read().select("document_id", "chunk_index", F.md5("text").alias("text_md5"))


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents, by project; then every third document gets its trimmed text, and all others stay."""
    path = _folder(spark, "document-texts")
    project = F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("project_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(project, F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("cleaned_text"))
    analyses.write_texts(docs, path)
    analyses.write_texts(docs.where("document_id % 3 = 0").withColumn("cleaned_text", F.trim("raw_text")), path)
    return spark.read.parquet(path).select("project_id", "document_id", F.md5("raw_text").alias("raw_md5"), F.md5("cleaned_text").alias("cleaned_md5"))


def streamed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers arrive in a stream's inbox, and afterwards older versions of them: the chunks are those of the papers."""
    folder = _folder(spark, "stream")
    inbox, store, state = (f"{folder}/{x}" for x in ("inbox", "chunks", "state"))
    rows = papers(spark, sf_dir, 40).select("document_id", "raw_text", "page_count", F.lit(None).cast("string").alias("extraction_error"))
    for text, at in ((F.col("raw_text"), 2), (F.lit("Abstract\nAn older version."), 1)):
        rows.select("document_id", text.alias("raw_text"), "page_count", "extraction_error", F.timestamp_seconds(F.lit(at)).alias("arrived_at")).write.mode("append").parquet(inbox)
        ingest.ingest_stream(spark, inbox, store, state).awaitTermination()
    return analyses.read_chunks(spark, store)


QUERIES = (snapshot_chunks, stored_texts, streamed_chunks)

SQL: dict[str, str] = {
    "snapshot_chunks": tables.SQL["replaced_chunks"],
    "stored_texts": """SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS project_id, doc_id AS document_id, md5(text) AS raw_md5,
  md5(CASE WHEN doc_id % 3 = 0 THEN trim(text) END) AS cleaned_md5 FROM documents""",
    "streamed_chunks": ingest_plans.SQL["section_chunks"] + " WHERE document_id > 0",  # other ids are never stored
}
