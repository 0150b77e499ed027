"""Document status, listings, latest analyses and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

OCR_WORDS = 10
# Messages by status.
OCR_MESSAGE = "Very little text was extracted. OCR may be needed."
SUMMARIES = {
    "ocr_needed": ("Document was saved, but very little text was extracted. OCR may be needed.", "Use a text-based PDF or add OCR support in a later workflow."),
    "extraction_failed": ("Document was saved, but local PDF text extraction failed.", "Verify the PDF is readable and try uploading it again."),
    "text_processing_failed": ("Document text was extracted, but text artifact storage failed.", "Check local storage permissions and retry processing."),
    "section_detection_failed": ("Document text was cleaned, but section detection output could not be stored.", "Check local database access and retry processing."),
    "chunking_failed": ("Document sections were detected, but chunk storage failed.", "Check local database access and retry processing."),
}
NEXT_WHEN_DONE = "Review the overview or continue with the next local analysis step."
NEXT_OTHERWISE = "Wait for processing to finish or inspect the document status."


def is_ocr_likely_needed(text: Column) -> Column:
    return T.word_count(text) < OCR_WORDS


def derive_status(documents: DataFrame, text_col: str = "raw_text", error_col: str = "extraction_error") -> DataFrame:
    """Add status, word_count and status_message: extraction_failed where there is an error, ocr_needed below ten words,
    else processed. Failed documents have no counts."""
    failed = F.coalesce(T.strip(F.col(error_col)) != "", F.lit(False))
    words = T.word_count(F.col(text_col))
    status = F.when(failed, "extraction_failed").when(words < OCR_WORDS, "ocr_needed").otherwise("processed")
    message = F.when(failed, T.strip(F.col(error_col))).when(words < OCR_WORDS, OCR_MESSAGE)
    return documents.withColumns({"status": status, "word_count": F.when(~failed, words), "status_message": message})


def update_extraction_metadata(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite counts, error, warnings and status of the documents that `updates` names.

    `updates`: document_id, status, page_count, word_count, extraction_error, cleaning_warnings (array). Errors are
    trimmed and blank ones become null, warnings are joined by newlines; updates with a blank status are errors, which
    surface when the row is read.
    """
    error = F.nullif(T.strip(F.col("extraction_error")), F.lit(""))
    warnings = F.nullif(F.array_join("cleaning_warnings", "\n"), F.lit(""))
    status = F.when(T.strip(T.text_or_empty(F.col("status"))) != "", T.strip(F.col("status"))).otherwise(F.raise_error(F.lit("status must not be blank")))
    new = updates.select("document_id", F.struct(
        status.alias("status"), "page_count", "word_count", error.alias("extraction_error"), warnings.alias("cleaning_warnings")
    ).alias("_new"))
    out = documents.join(new, "document_id", "left")
    for c in ("status", "page_count", "word_count", "extraction_error", "cleaning_warnings"):
        out = out.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.drop("_new")


def list_documents(documents: DataFrame, project_id: int) -> DataFrame:
    """Documents of a project, newest first."""
    return documents.where(F.col("project_id") == project_id).orderBy(F.desc("uploaded_at"), F.desc("document_id"))


def list_projects(projects: DataFrame, user_id: int | None = None) -> DataFrame:
    """Projects, of one user if one is given, newest first."""
    own = projects if user_id is None else projects.where(F.col("user_id") == user_id)
    return own.orderBy(F.desc("created_at"), F.desc("id"))


def latest_analysis(analyses: DataFrame, analysis_type: str | None = None) -> DataFrame:
    """The newest analysis per document and type. An aggregation, so that old rows go before the shuffle."""
    own = analyses if analysis_type is None else analyses.where(F.col("analysis_type") == analysis_type)
    rest = [c for c in analyses.columns if c not in ("document_id", "analysis_type")]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_a")
    return own.groupBy("document_id", "analysis_type").agg(newest).select("document_id", "analysis_type", "_a.*")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.select("document_id").join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def processing_summary(status: Column, section_count: Column, chunk_count: Column) -> Column:
    """A struct of message, is_complete, requires_attention, next_step."""
    def row(message: Column, done: bool, attention: bool, then: str) -> Column:
        return F.struct(message.alias("message"), F.lit(done).alias("is_complete"), F.lit(attention).alias("requires_attention"), F.lit(then).alias("next_step"))

    done = F.format_string("Document processed locally with %d detected sections and %d stored chunks.", section_count, chunk_count)
    out = F.when(status == "processed", row(done, True, False, NEXT_WHEN_DONE))
    for name, (message, then) in SUMMARIES.items():
        out = out.when(status == name, row(F.lit(message), False, True, then))
    other = F.format_string("Document is currently in '%s' status.", status)
    return out.otherwise(row(other, False, False, NEXT_OTHERWISE))


def warning_lines(*columns: Column) -> Column:
    return F.filter(F.concat(*[F.transform(T.lines(c), lambda l: T.strip(l)) for c in columns]), lambda l: l != "")


def document_overview(documents: DataFrame, chunks: DataFrame, analyses: DataFrame) -> DataFrame:
    """Documents with chunk counts, the sections of the latest section analysis, warnings and a summary. All joins go
    by document_id, so one partitioning serves them."""
    from folioflow.sources.analyses import read_sections

    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    found = latest_analysis(analyses, "section_detection").select("document_id", read_sections(F.col("content")).alias("detected_sections"))
    out = documents.join(counts, "document_id", "left").join(found, "document_id", "left")
    out = out.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    out = out.withColumn("detected_sections", F.coalesce("detected_sections", F.array().cast(dict(found.dtypes)["detected_sections"])))
    return out.select(
        "document_id", F.col("original_filename").alias("filename"), "status", "page_count", "word_count", "chunk_count",
        "detected_sections", warning_lines(F.col("extraction_error"), F.col("cleaning_warnings")).alias("extraction_warnings"),
        processing_summary(F.col("status"), F.size("detected_sections"), F.col("chunk_count")).alias("processing_summary"),
    )


def public_documents(documents: DataFrame) -> DataFrame:
    """Without internal names, paths and cleaning warnings."""
    return documents.drop("stored_filename", "file_path", "extracted_text_path", "cleaned_text_path", "cleaning_warnings")


def ordered_chunks(chunks: DataFrame, document_id: int) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index", *[c for c in ("id",) if c in chunks.columns])


def running_order(chunks: DataFrame) -> DataFrame:
    """Chunks of all documents with their place in the document, from 0."""
    order = Window.partitionBy("document_id").orderBy("chunk_index", *[c for c in ("id",) if c in chunks.columns])
    return chunks.withColumn("place", F.row_number().over(order) - 1)
