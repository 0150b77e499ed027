"""Local analyses as rows of the analysis log: overviews, section summaries, research information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.operators import research, summaries
from folioflow.operators.metadata import latest_analysis
from folioflow.sources.analyses import analysis_rows, read_content

# Types and titles of stored analyses, and limitations of all summaries of a document.
OVERVIEW = ("document_overview_local", "Local document overview analysis")
SUMMARIES = ("section_summaries_local", "Local section summaries")
RESEARCH = ("research_info_local", "Local research information extraction")
EXTRACTIVE = "Summaries are extractive and local; they select source sentences instead of generating new prose."
NO_SUMMARIES = "No useful summary sentences were found in supported sections."
NO_SECTIONS = "No stored section detection output was found. Upload and process the document first."

# Shapes of the contents, for strict reading.
OVERVIEW_SCHEMA = """document_id long, filename string, keywords array<struct<frequency: int, keyword: string, score: double>>,
    statistics struct<chunk_count_by_section: map<string, long>, readability: struct<average_syllables_per_word: double,
    average_words_per_sentence: double, flesch_reading_ease: double, sentence_count: int>, reference_count_estimate: int,
    total_word_count: int, word_count_by_section: map<string, int>>"""
RESEARCH_SCHEMA = """document_id long, fields map<string, struct<confidence: double, extracted_text: string, field: string,
    source_section: string>>, filename string, warnings array<string>"""
SUMMARIES_SCHEMA = """document_id long, limitations array<string>, source_section_names array<string>,
    summaries array<struct<confidence: double, limitations: array<string>, section_name: string, section_type: string,
    selected_sentence_count: int, source_sentence_indexes: array<int>, summary: string>>"""


def _ordered(rank: str, *fields: str | Column) -> Column:
    """The rows of a group as structs, in order of their rank."""
    return F.transform(F.sort_array(F.collect_list(F.struct(rank, F.struct(*fields).alias("row")))), lambda x: x["row"])


def overview_rows(documents: DataFrame, keywords: DataFrame, statistics: DataFrame) -> DataFrame:
    """Log rows with the file name, the keywords by rank and the statistics. `documents` has document_id, project_id and
    original_filename; documents without statistics (no cleaned text) get no row. Joins go by document_id."""
    words = keywords.groupBy("document_id").agg(_ordered("rank", "frequency", "keyword", "score").alias("keywords"))
    readability = F.struct("average_syllables_per_word", "average_words_per_sentence", "flesch_reading_ease", "sentence_count")
    numbers = statistics.select("document_id", F.struct(
        "chunk_count_by_section", readability.alias("readability"), "reference_count_estimate", "total_word_count", "word_count_by_section"
    ).alias("statistics"))
    rows = documents.join(numbers, "document_id").join(words, "document_id", "left")
    found = F.coalesce("keywords", F.from_json(F.lit('{"x": []}'), f"x {dict(words.dtypes)['keywords']}")["x"])
    content = F.struct("document_id", F.col("original_filename").alias("filename"), found.alias("keywords"), "statistics")
    return analysis_rows(rows, OVERVIEW[0], content, F.lit(OVERVIEW[1]))


def whole_text_sections(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Texts without detected sections, each as one unknown section; blank ones have none."""
    rows = df.where(T.strip(T.text_or_empty(F.col(text_col))) != "")
    return rows.select(
        key, F.lit(0).alias("section_pos"), F.lit("unknown").alias("section_type"), F.lit("Full Document").alias("section_name"), F.col(text_col).alias("text")
    )


def research_rows(documents: DataFrame, sections: DataFrame, items: DataFrame) -> DataFrame:
    """Log rows with the first item of each field and the warnings."""
    first = research.primary_fields(documents, items, "document_id")
    one = F.struct("field", F.struct("confidence", "extracted_text", "field", "source_section").alias("value"))
    fields = first.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(one))).alias("fields"))
    warned = research.research_warnings(documents, sections, items, "document_id")
    rows = documents.join(fields, "document_id").join(warned, "document_id")
    content = F.struct("document_id", "fields", F.col("original_filename").alias("filename"), "warnings")
    return analysis_rows(rows, RESEARCH[0], content, F.lit(RESEARCH[1]))


def summary_rows(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Log rows with the best summary per section type, in the order of the types, and the limitations."""
    best = summaries.best_summaries(summaries.summarize_sections(sections, "document_id"), "document_id")
    best = best.withColumns({"limitations": summaries.summary_limitations(), "section_name": F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit("Unknown"))})
    fields = ("confidence", "limitations", "section_name", "section_type", "selected_sentence_count", "source_sentence_indexes", "summary")
    found = best.groupBy("document_id").agg(_ordered("position", *fields).alias("summaries"))
    known = sections.select("document_id").distinct().withColumn("_known", F.lit(True))
    rows = documents.join(known, "document_id", "left").join(found, "document_id", "left")
    kind = dict(found.dtypes)["summaries"]
    rows = rows.withColumn("summaries", F.coalesce("summaries", F.from_json(F.lit('{"x": []}'), f"x {kind}")["x"]))
    limits = F.when(F.col("_known").isNull(), F.array(F.lit(NO_SECTIONS))).when(F.size("summaries") == 0, F.array(F.lit(EXTRACTIVE), F.lit(NO_SUMMARIES)))
    content = F.struct(
        "document_id", limits.otherwise(F.array(F.lit(EXTRACTIVE))).alias("limitations"),
        F.transform("summaries", lambda s: s["section_name"]).alias("source_section_names"), "summaries",
    )
    return analysis_rows(rows, SUMMARIES[0], content, F.lit(SUMMARIES[1]))


def read_latest(log: DataFrame, analysis_type: str, schema: str) -> DataFrame:
    """The newest analysis of a type per document, its content parsed; a content that is no such JSON is an error."""
    return latest_analysis(log, analysis_type).withColumn("content", read_content(F.col("content"), schema))
