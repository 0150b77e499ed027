"""Registered queries: pages, manifests, status, listings, analyses, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import metadata
from folioflow.plans.ingest import _WHOLE, chunks_sql, cleaning_sql, document_chunks, sectioned_papers, sections_sql, strip_sql, words_sql
from folioflow.plans.papers import papers
from folioflow.sources import analyses, pages

STATUSES = ("processed", "ocr_needed", "extraction_failed", "text_processing_failed", "section_detection_failed", "chunking_failed", "stored")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows that follow from the ids: names, types, sizes, states and times of all kinds."""
    d, k = F.col("doc_id"), F.col("doc_id") % 11
    name = F.concat(F.when(k == 3, "C:\\Pläne\\").when(k == 5, "../up/").otherwise(""), F.lit("Über Paper "), d.cast("string"), F.when(k == 4, ".TXT").when(k == 6, ".Pdf").otherwise(".pdf"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        d.alias("document_id"), F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("project_id"), name.alias("original_filename"),
        F.when(k == 7, "text/plain").when(k == 8, "application/x-pdf").when(k != 9, "application/pdf").alias("mime_type"),
        (F.col("n_chars") * F.when(k == 10, 10_000_000).otherwise(3)).alias("file_size_bytes"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (d % len(STATUSES) + 1).cast("int")).alias("status"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 3000)).cast("int").alias("page_count"),
        F.when(d % 5 == 0, F.concat_ws("\n", F.lit(" first "), F.lit(""), F.lit("second"))).alias("extraction_error"),
        F.when(d % 4 == 0, "cleaning warning").alias("cleaning_warnings"),
        (d - d % 3).alias("uploaded_at"), "text",
    )


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources as projects of two users."""
    return _documents(spark, sf_dir).groupBy(F.col("project_id").alias("id")).agg(
        F.max("uploaded_at").alias("created_at")).withColumn("user_id", F.col("id") % 2)


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return pages.assemble_pages(turns, "conv_id", "turn")


def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh document names a project that there isn't."""
    unknown = F.when(F.col("document_id") % 11 == 2, F.col("project_id") + 1000).otherwise(F.col("project_id"))
    out = pages.validate_manifest(_documents(spark, sf_dir).withColumn("project_id", unknown), _projects(spark, sf_dir))
    return out.select("document_id", "project_id", "problem")


def row_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("word_count", F.when(F.col("document_id") % 6 == 0, -1))
    rows = rows.withColumn("original_filename", F.when(F.col("document_id") % 9 == 0, F.repeat("original_filename", 20)).otherwise(F.col("original_filename")))
    return pages.row_problems(rows).select("document_id", F.array_join("problems", ",").alias("problems"))


def stored_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("document_id", pages.stored_filename(F.col("original_filename"), F.md5(F.col("document_id").cast("string"))).alias("stored_filename"))


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).withColumn("extraction_error", F.when(F.col("document_id") % 13 == 0, " broken file "))
    # besides the papers, a document of few words per document: its language and source
    few = spark.read.parquet(f"{sf_dir}/documents.parquet").select((-1 - F.col("doc_id")).alias("document_id"), F.concat_ws(" ", "lang", "source").alias("raw_text"))
    out = metadata.derive_status(rows.unionByName(few, allowMissingColumns=True))
    return out.select("document_id", "status", F.coalesce("word_count", F.lit(-1)).alias("word_count"), "status_message")


def extraction_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("word_count", F.lit(None).cast("int")).drop("text")
    updates = rows.where("document_id % 2 = 0").select(
        "document_id", F.lit(" processed ").alias("status"), F.lit(7).alias("page_count"), (F.col("document_id") % 100).cast("int").alias("word_count"),
        F.when(F.col("document_id") % 4 == 0, "  ").otherwise(" slow ").alias("extraction_error"), F.array(F.lit("a"), F.lit("b")).alias("cleaning_warnings"),
    )
    out = metadata.update_extraction_metadata(rows, updates).withColumn("word_count", F.coalesce("word_count", F.lit(-1)))
    return out.select("document_id", "status", "page_count", "word_count", "extraction_error", "cleaning_warnings")


def projects_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.list_projects(_projects(spark, sf_dir), 1)


def documents_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = metadata.list_documents(metadata.public_documents(_documents(spark, sf_dir)), 7)
    return listed.select("document_id", "original_filename", "status", "uploaded_at")


def latest_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an analysis log: the newest event of each type per user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("analysis_type"), F.col("ts").alias("created_at"))
    return metadata.latest_analysis(log).select("document_id", "analysis_type", "id")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    return metadata.chunk_counts(docs, document_chunks(spark, sf_dir))


def processing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.select("document_id", "status", metadata.processing_summary(F.col("status"), F.col("page_count"), F.col("page_count") + 1).alias("s")).select("document_id", "status", "s.*")


def _section_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section analyses of papers as stored JSON, some of them malformed."""
    rows = sectioned_papers(spark, sf_dir)
    found = F.transform("sections", lambda s: F.struct(
        s["confidence"].alias("confidence"), s["detected_heading"].alias("detected_heading"), s["section_name"].alias("section_name"),
        s["section_type"].alias("section_type"), s["text"].alias("text"),
    ))
    stored = analyses.analysis_rows(rows, "section_detection", found)
    d = F.col("document_id")
    bad = F.when(d % 17 == 1, "not json").when(d % 17 == 2, '{"a": 1}').when(d % 17 == 3, '[3, "x", {"confidence": "2.5"}, {"section_name": " ", "confidence": "high"}]')
    return stored.withColumn("content", F.coalesce(bad, "content")).withColumn("id", d)


def analysis_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _section_log(spark, sf_dir).select("document_id", F.posexplode_outer(analyses.read_sections(F.col("content"))).alias("section_pos", "s"))
    rows = rows.withColumn("section_pos", F.coalesce("section_pos", F.lit(-1)))
    return rows.select("document_id", "section_pos", "s.section_type", "s.section_name", "s.detected_heading", "s.confidence")


def document_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("word_count", F.length("text")).drop("text")
    log = _section_log(spark, sf_dir)
    out = metadata.document_overview(docs, document_chunks(spark, sf_dir), log)
    return out.select(
        "document_id", "filename", "status", "page_count", "word_count", "chunk_count", F.size("detected_sections").alias("section_count"),
        F.array_join("extraction_warnings", "|").alias("warnings"), "processing_summary.message", "processing_summary.is_complete",
    )


def cleaned_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.create_map(F.lit("lang"), F.concat(F.lit(" "), "lang"), F.lit("note"), F.when(k == 0, " \t").when(k == 1, " kept "), F.lit("source"), F.concat("source", F.lit("\n")))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), pages.clean_metadata(raw).alias("m"))
    flat = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("document_id", F.array_join(flat, ",").alias("metadata"))


def project_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project per document, with blank, long and good names."""
    d = F.col("doc_id")
    name = F.when(d % 5 == 0, "  ").when(d % 5 == 1, F.repeat("source", 40)).otherwise(F.concat(F.lit(" "), "source"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(d.alias("id"), name.alias("name"))
    return pages.project_problems(rows).select("id", "name", F.array_join("problems", ",").alias("problems"))


def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.running_order(document_chunks(spark, sf_dir)).select("document_id", "chunk_index", "place")


def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an even id get their chunks anew, those divisible by 4 none."""
    old = document_chunks(spark, sf_dir).select("document_id", "chunk_index", "text")
    touched = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id")).where("document_id % 2 = 0")
    new = old.where("document_id % 4 != 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return analyses.replace_chunks(old, new, touched).select("document_id", "chunk_index", F.md5("text").alias("text_md5"))


QUERIES = (
    assemble_pages, manifest_validate, row_constraints, stored_filenames, document_status, extraction_updates, projects_listing,
    documents_listing, latest_analyses, chunk_counts, processing_summaries, analysis_json_roundtrip, document_overviews, replaced_chunks,
    cleaned_metadata, project_constraints, chunk_order,
)

_STATUS = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
_DOCS = f"""docs AS (SELECT doc_id AS document_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS project_id,
  CASE doc_id % 11 WHEN 3 THEN 'C:\\Pläne\\' WHEN 5 THEN '../up/' ELSE '' END || 'Über Paper ' || doc_id || CASE doc_id % 11 WHEN 4 THEN '.TXT' WHEN 6 THEN '.Pdf' ELSE '.pdf' END AS original_filename,
  CASE doc_id % 11 WHEN 7 THEN 'text/plain' WHEN 8 THEN 'application/x-pdf' WHEN 9 THEN NULL ELSE 'application/pdf' END AS mime_type,
  n_chars * CASE WHEN doc_id % 11 = 10 THEN 10000000 ELSE 3 END AS file_size_bytes, {_STATUS}[doc_id % {len(STATUSES)} + 1] AS status,
  CAST(greatest(1, ceil(n_chars / 3000.0)) AS INTEGER) AS page_count, CASE WHEN doc_id % 5 = 0 THEN ' first ' || chr(10) || chr(10) || 'second' END AS extraction_error,
  CASE WHEN doc_id % 4 = 0 THEN 'cleaning warning' END AS cleaning_warnings, doc_id - doc_id % 3 AS uploaded_at, text FROM documents),
projects AS (SELECT project_id AS id, max(uploaded_at) AS created_at, project_id % 2 AS user_id FROM docs GROUP BY project_id)"""
_SUMMARY = " ".join(f"WHEN '{s}' THEN '{m}'" for s, (m, _) in metadata.SUMMARIES.items())
_NEXT = " ".join(f"WHEN '{s}' THEN '{n}'" for s, (_, n) in metadata.SUMMARIES.items())


def _message(sections: str, chunks: str) -> str:
    return f"CASE status WHEN 'processed' THEN 'Document processed locally with ' || {sections} || ' detected sections and ' || {chunks} || ' stored chunks.' {_SUMMARY} ELSE 'Document is currently in ''' || status || ''' status.' END"


_LOG = f"""{sections_sql()},
parsed AS (SELECT document_id, CAST(section_pos AS INTEGER) AS section_pos, section_type, section_name, heading AS detected_heading, confidence FROM sections WHERE document_id % 17 NOT IN (1, 2, 3)
  UNION ALL SELECT document_id, p, 'unknown', 'Unknown', '', c FROM papers, (VALUES (0, 1.0::DOUBLE), (1, 0.0::DOUBLE)) v(p, c) WHERE document_id % 17 = 3)"""

SQL: dict[str, str] = {
    "assemble_pages": f"""SELECT conv_id, CAST(count(*) AS INTEGER) AS page_count, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '') AS full_text,
  coalesce(string_agg(t, '') FILTER (t <> ''), '') <> '' AS has_text FROM (SELECT *, {strip_sql("coalesce(text, '')")} AS t FROM conversations) GROUP BY conv_id""",
    "manifest_validate": f"""WITH {_DOCS}, named AS (SELECT * REPLACE (CASE WHEN document_id % 11 = 2 THEN project_id + 1000 ELSE project_id END AS project_id) FROM docs)
SELECT document_id, project_id, CASE WHEN lower(original_filename) NOT LIKE '%.pdf' THEN 'not a PDF file name'
  WHEN mime_type NOT IN ('application/pdf', 'application/x-pdf') THEN 'not a PDF content type' WHEN file_size_bytes > {pages.MAX_BYTES} THEN 'file is too large'
  WHEN project_id NOT IN (SELECT id FROM projects) THEN 'project does not exist' END AS problem FROM named""",
    "row_constraints": f"""WITH {_DOCS} SELECT document_id, concat_ws(',', CASE WHEN document_id % 9 = 0 AND length(original_filename) * 20 > 255 THEN 'original_filename' END,
  CASE WHEN document_id % 6 = 0 THEN 'word_count' END) AS problems FROM docs""",
    "stored_filenames": f"""WITH {_DOCS} SELECT document_id, md5(CAST(document_id AS VARCHAR)) || '_' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(original_filename, '([^/\\\\]*)\\.[^.]*$', 1), '[^A-Za-z0-9._-]+', '_', 'g'),
  '^[._-]+', ''), '[._-]+$', ''), '_+', '_', 'g') || '.' || lower(regexp_extract(original_filename, '\\.([^.]*)$', 1)) AS stored_filename FROM docs""",
    "document_status": f"""WITH {cleaning_sql()}, every AS (SELECT document_id, raw_text AS t FROM papers UNION ALL SELECT -1 - doc_id, concat_ws(' ', lang, source) FROM documents), n AS (SELECT *, {words_sql("t")} AS w FROM every)
SELECT document_id, CASE WHEN document_id >= 0 AND document_id % 13 = 0 THEN 'extraction_failed' WHEN w < 10 THEN 'ocr_needed' ELSE 'processed' END AS status, CASE WHEN document_id < 0 OR document_id % 13 <> 0 THEN CAST(w AS INTEGER) ELSE -1 END AS word_count,
  CASE WHEN document_id >= 0 AND document_id % 13 = 0 THEN 'broken file' WHEN w < 10 THEN '{metadata.OCR_MESSAGE}' END AS status_message FROM n""",
    "extraction_updates": f"""WITH {_DOCS} SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'processed' ELSE status END AS status, CASE WHEN document_id % 2 = 0 THEN 7 ELSE page_count END AS page_count,
  CASE WHEN document_id % 2 = 0 THEN CAST(document_id % 100 AS INTEGER) ELSE -1 END AS word_count, CASE WHEN document_id % 4 = 0 THEN NULL WHEN document_id % 2 = 0 THEN 'slow' ELSE extraction_error END AS extraction_error,
  CASE WHEN document_id % 2 = 0 THEN 'a' || chr(10) || 'b' ELSE cleaning_warnings END AS cleaning_warnings FROM docs""",
    "projects_listing": f"WITH {_DOCS} SELECT id, created_at, user_id FROM projects WHERE user_id = 1",
    "documents_listing": f"WITH {_DOCS} SELECT document_id, original_filename, status, uploaded_at FROM docs WHERE project_id = 7",
    "latest_analyses": "SELECT user_id AS document_id, event_type AS analysis_type, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "chunk_counts": f"WITH {_WHOLE}, {chunks_sql('whole')} SELECT doc_id AS document_id, count(chunk_index) AS chunk_count FROM documents LEFT JOIN chunks ON document_id = doc_id GROUP BY doc_id",
    "processing_summaries": f"""WITH {_DOCS} SELECT document_id, status, {_message("page_count", "(page_count + 1)")} AS message, status = 'processed' AS is_complete, status NOT IN ('processed', 'stored') AS requires_attention,
  CASE status WHEN 'processed' THEN '{metadata.NEXT_WHEN_DONE}' {_NEXT} ELSE '{metadata.NEXT_OTHERWISE}' END AS next_step FROM docs""",
    "analysis_json_roundtrip": f"WITH {_LOG} SELECT p.document_id, coalesce(section_pos, -1) AS section_pos, section_type, section_name, detected_heading, confidence FROM papers p LEFT JOIN parsed USING (document_id)",
    "document_overviews": f"""WITH {_DOCS}, {_WHOLE}, {chunks_sql("whole")}, {_LOG}, cc AS (SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY 1), sc AS (SELECT document_id, count(*) AS n FROM parsed GROUP BY 1),
j AS (SELECT d.*, coalesce(cc.chunk_count, 0) AS chunk_count, coalesce(n, 0) AS section_count FROM docs d LEFT JOIN cc USING (document_id) LEFT JOIN sc USING (document_id))
SELECT document_id, original_filename AS filename, status, page_count, CAST(length(text) AS INTEGER) AS word_count, chunk_count, CAST(section_count AS INTEGER) AS section_count,
  concat_ws('|', CASE WHEN document_id % 5 = 0 THEN 'first|second' END, cleaning_warnings) AS warnings, {_message("section_count", "chunk_count")} AS message, status = 'processed' AS is_complete FROM j""",
    "replaced_chunks": f"""WITH {_WHOLE}, {chunks_sql("whole")} SELECT document_id, chunk_index, md5(CASE WHEN document_id % 2 = 0 AND document_id > 0 THEN 'new ' || text ELSE text END) AS text_md5 FROM chunks
WHERE document_id % 4 <> 0 OR document_id = 0""",
    "cleaned_metadata": """SELECT doc_id AS document_id, concat_ws(',', 'lang=' || nullif(trim(lang), ''), CASE WHEN doc_id % 3 = 1 THEN 'note=kept' END, 'source=' || nullif(trim(source), '')) AS metadata FROM documents""",
    "project_constraints": """SELECT id, n AS name, CASE WHEN length(n) BETWEEN 1 AND 200 THEN '' ELSE 'name' END AS problems FROM (
  SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN coalesce(repeat(source, 40), '') ELSE coalesce(trim(source), '') END AS n FROM documents)""",
    "chunk_order": f"WITH {_WHOLE}, {chunks_sql('whole')} SELECT document_id, chunk_index, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS INTEGER) AS place FROM chunks",
}
