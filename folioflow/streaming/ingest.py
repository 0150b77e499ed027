"""Incremental ingest: each arriving document is cleaned, cut and stored; a document that comes again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.chunking import split_sections_into_chunks
from folioflow.operators.cleaning import clean_text
from folioflow.operators.metadata import derive_status
from folioflow.operators.sections import detect_sections
from folioflow.sources.analyses import newest_versions, overwrite_chunks
from folioflow.sources.shared import scratch

SCHEMA = "document_id long, raw_text string, page_count int, extraction_error string, arrived_at timestamp"


def process(documents: DataFrame) -> DataFrame:
    """Status, cleaned text and sections of documents: a stateless projection, good for batches and streams."""
    return detect_sections(clean_text(derive_status(documents), "raw_text"))


def newest(documents: DataFrame) -> DataFrame:
    """Of several arrivals of a document in one batch, the last."""
    last = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("arrived_at"), F.desc_nulls_last("raw_text"))
    return documents.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def timely(documents: DataFrame, path: str) -> DataFrame:
    """Arrivals that are later than what is stored of their document: the table of touched documents is the state, keyed
    by document, and the others needn't be cleaned and cut at all. Arrivals without a time are taken as they come."""
    state = newest_versions(documents.sparkSession, path)
    if state is None:
        return documents
    stored = state.select("document_id", F.col("event").alias("_event"))
    return documents.join(stored, "document_id", "left").where("_event is null or arrived_at is null or unix_micros(arrived_at) * 1000 > _event").drop("_event")


def ingest_stream(spark: SparkSession, inbox: str, chunks_path: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Start the stream over Parquet files that arrive in `inbox`; it takes what is there and ends.

    A document that comes again replaces itself if its `arrived_at` is later than that of what is stored, in whatever
    batch it comes; equal times are one arrival. So a batch that is repeated after a failure, and files that are
    delivered twice or late, give the same table.
    """
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)

    def store(batch: DataFrame, _: int) -> None:
        # which arrivals count is known from their times alone; texts move once, to more tasks than cores, and are cut there
        times = batch.groupBy("document_id").agg(F.max("arrived_at").alias("arrived_at"))
        taken = scratch(timely(times, chunks_path), "arrivals")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        rows = newest(batch.repartition(parts, "document_id").join(taken.select("document_id"), "document_id", "left_semi"))
        overwrite_chunks(split_sections_into_chunks(process(rows)), taken, chunks_path)

    return arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
