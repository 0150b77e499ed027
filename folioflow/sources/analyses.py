"""Stored analyses: JSON in and out, chunks and texts on disk."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.sources.shared import scratch

SECTION = "section_type string, section_name string, detected_heading string, text string, confidence string"
PROVIDER = "local"


def read_sections(content: Column) -> Column:
    """Sections of a stored analysis; what is no JSON list gives none, what is no object is passed over, absent values
    get defaults, a confidence that is no number is 0 and others are brought into 0 to 1."""
    items = F.coalesce(F.from_json(content, "array<string>"), F.array().cast("array<string>"))
    objects = F.transform(F.filter(items, lambda x: x.startswith("{")), lambda x: F.from_json(x, SECTION))

    def row(s: Column) -> Column:
        text = lambda c, none: F.coalesce(F.nullif(s[c], F.lit("")), F.lit(none))
        sure = F.coalesce(s["confidence"].try_cast("double"), F.lit(0.0))
        return F.struct(
            text("section_type", "unknown").alias("section_type"),
            F.coalesce(F.nullif(T.strip(text("section_name", "Unknown")), F.lit("")), F.lit("Unknown")).alias("section_name"),
            T.strip(text("detected_heading", "")).alias("detected_heading"), text("text", "").alias("text"),
            F.greatest(F.lit(0.0), F.least(F.when(F.isnan(sure), 0.0).otherwise(sure), F.lit(1.0))).alias("confidence"),
        )

    return F.transform(objects, row)


def read_content(content: Column, schema: str) -> Column:
    """A stored document of a known shape; here bad JSON is an error."""
    return F.from_json(content, schema, {"mode": "FAILFAST"})


def analysis_rows(df: DataFrame, analysis_type: str, content: Column, title: Column | None = None) -> DataFrame:
    """Rows for the analysis log of (project_id, document_id, ...); struct fields should be in alphabetical order."""
    return df.select(
        "project_id", "document_id", F.lit(analysis_type).alias("analysis_type"),
        (title if title is not None else F.lit(None).cast("string")).alias("title"),
        F.to_json(content, {"ignoreNullFields": "false"}).alias("content"), F.lit(PROVIDER).alias("provider_mode"), F.current_timestamp().alias("created_at"),
    )


def append_analyses(rows: DataFrame, path: str) -> None:
    """Append to the log, laid out by type, so that reading one type reads its folder only."""
    rows.write.mode("append").partitionBy("analysis_type").parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    """Raw and cleaned text of each document, laid out by project. Documents that are there get their new texts; all
    others stay, in other projects and in the same ones: only folders of projects that `df` names are written."""
    spark = df.sparkSession
    new = scratch(df.select("project_id", "document_id", "raw_text", "cleaned_text"), "texts")
    old = _table_or_none(spark, path)
    if old is not None:
        ids, projects = new.select("document_id").distinct(), new.select("project_id").distinct()
        stay = old.join(projects, "project_id", "left_semi").join(ids, "document_id", "left_anti")
        new = scratch(new.unionByName(stay.select(new.columns)), "texts")  # what is read can't be overwritten at once
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def append_chat(chat: DataFrame, path: str) -> None:
    chat.select("project_id", "document_id", "question", "answer", "provider_mode", F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)


def replace_chunks(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """All chunks after the documents in `touched` got the new ones; a document without new chunks loses its own."""
    ids = touched.select("document_id").where("document_id > 0").distinct()
    return old.join(ids, "document_id", "left_anti").unionByName(new.join(ids, "document_id", "left_semi"))


def _table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # before the first write there is none
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def overwrite_chunks(new: DataFrame, touched: DataFrame, path: str) -> None:
    """The same on disk, by appending: chunks with a version first, then the touched documents with that version, which
    makes them count. Nothing that is stored is written again; a write that fails before its end changes nothing.

    Where `touched` says when a document came (`arrived_at`), the latest counts, whatever the order of the writes; else
    the time of the write does.
    """
    spark = new.sparkSession
    before = _table_or_none(spark, f"{path}/touched")
    last = (before.agg(F.max("version")).first()[0] or 0) if before is not None else 0
    version = F.lit(max(time.time_ns(), last + 1))
    came = F.unix_micros("arrived_at") * 1000 if "arrived_at" in touched.columns else F.lit(None)
    ids = touched.select("document_id", came.cast("long").alias("event")).where("document_id > 0").groupBy("document_id").agg(F.max("event").alias("event"))
    new.join(ids.select("document_id"), "document_id", "left_semi").withColumn("version", version).write.mode("append").parquet(f"{path}/chunks")
    ids.withColumn("version", version).write.mode("append").parquet(f"{path}/touched")


def newest_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(document_id, version, event) that count, or None before the first write: of each document the latest event, of
    equal ones the last write. Writes that name no event count as events at their own time."""
    touched = _table_or_none(spark, f"{path}/touched")
    if touched is None:
        return None
    event = F.coalesce("event", "version") if "event" in touched.columns else F.col("version")
    best = touched.groupBy("document_id").agg(F.max(F.struct(event.alias("event"), "version")).alias("v"))
    return best.select("document_id", "v.version", "v.event")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that `overwrite_chunks` keeps: of each document those of its newest version."""
    newest = newest_versions(spark, path)
    if newest is None:
        raise ValueError(f"no chunks were written to {path}")
    return spark.read.parquet(f"{path}/chunks").join(newest.drop("event"), ["document_id", "version"]).drop("version")


def compact_chunks(spark: SparkSession, path: str, target: str) -> None:
    """Write what counts to a new place, without the versions that don't."""
    kept = read_chunks(spark, path)
    overwrite_chunks(kept, kept, target)
