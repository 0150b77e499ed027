"""A derived table of noisy papers: the lines of `documents` with titles, headers, page numbers, headings and cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.shared import documents

HEADINGS = (
    "Abstract", "1. Introduction", "2 Related Work", "3) METHODS", "4.1 Results of Trial", "Discussion", "6.1 Outlook",
    "References", "Threats to Validity",
)
CUES = (
    "The main problem is a lack of shared records in this area.",
    "The purpose of this work is to compare three simple plans.",
    "RQ1: Which question matters most to the people who took part?",
    "We chose a survey and an experiment with 3.14 hours per person.",
    "The sample had 120 participants from 4 towns.",
    "Each outcome is a measure of time, the dependent variable.",
    "We found that results show an increase of 12.5 points.",
    "A limitation is the bias of small groups, see https://example.org/x for more.",
    "[12] Stone, A. Notes on future work and further research.",
)
HEADER = "Working Draft"


def papers(spark: SparkSession, sf_dir: str, period: int = 3) -> DataFrame:
    """document_id, project_id, raw_text, page_count. `period` is the distance of headings in lines."""
    docs = documents(spark, sf_dir)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    heading, cue = (F.array(*map(F.lit, x)) for x in (HEADINGS, CUES))

    def around(line: F.Column, i: F.Column) -> F.Column:
        k = F.floor(i / period).cast("int")
        return F.concat_ws(
            "\n",
            F.when(i % 20 == 0, F.concat(F.lit(HEADER + "\n"), (F.floor(i / 20) + 1).cast("string"))),
            F.when((i % period == 0) & (k < 18), F.element_at(heading, k % 9 + 1)),
            F.when(i % 3 == 1, F.element_at(cue, ((i + F.col("doc_id")) % 9 + 1).cast("int"))),
            F.concat(line, F.when(i % 5 == 0, "\a").otherwise("")),
        )

    body = F.array_join(F.transform(lines, around), "\n")
    text = F.concat(F.lit("Study "), F.col("doc_id").cast("string"), F.lit("\n"), body)
    text = F.when(F.col("doc_id") % 7 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("project_id"),
        text.alias("raw_text"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 3000)).cast("int").alias("page_count"),
    )


def papers_sql(period: int = 3) -> str:
    """The same as a common table expression `papers`."""
    heading, cue = (", ".join("'" + x.replace("'", "''") + "'" for x in xs) for xs in (HEADINGS, CUES))
    return f"""papers AS (
  SELECT doc_id AS document_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS project_id,
    CASE WHEN doc_id % 7 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS raw_text,
    CAST(greatest(1, ceil(n_chars / 3000.0)) AS INTEGER) AS page_count
  FROM (SELECT *, 'Study ' || doc_id || chr(10) || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, j:
      concat_ws(chr(10),
        CASE WHEN (j - 1) % 20 = 0 THEN '{HEADER}' || chr(10) || CAST((j - 1) // 20 + 1 AS VARCHAR) END,
        CASE WHEN (j - 1) % {period} = 0 AND (j - 1) // {period} < 18 THEN [{heading}][((j - 1) // {period}) % 9 + 1] END,
        CASE WHEN (j - 1) % 3 = 1 THEN [{cue}][(j - 1 + doc_id) % 9 + 1] END,
        l || CASE WHEN (j - 1) % 5 = 0 THEN chr(7) ELSE '' END)), chr(10)) AS t FROM documents))"""
