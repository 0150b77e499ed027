"""Pages, manifests, metadata, stored analyses, streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import metadata, stored
from folioflow.sources import analyses, pages
from folioflow.streaming import ingest


def test_pages(spark):
    df = spark.createDataFrame([(1, 2, " two "), (1, 1, "one"), (1, 3, " "), (2, 1, None)], "document_id long, page_no int, text string")
    got = {r.document_id: r for r in pages.assemble_pages(df).collect()}
    assert (got[1].full_text, got[1].page_count, got[1].has_text) == ("one\n\ntwo", 3, True)
    assert (got[2].full_text, got[2].has_text) == ("", False)
    m = spark.range(1).select(pages.clean_metadata(F.create_map(F.lit("a"), F.lit(" x "), F.lit("b"), F.lit(" "), F.lit("c"), F.lit(None).cast("string"))).alias("m")).first().m
    assert m == {"a": "x"}


@pytest.mark.parametrize(
    ("name", "want"),
    [("My Paper.PDF", "My_Paper.pdf"), ("..\\x/a b.tar.gz", "a_b.tar.gz"), ("../", None), (" ", None), ("???.pdf", "document.pdf"), ("no extension", "no_extension"), ("..", None)],
)
def test_file_names(spark, name, want):
    assert spark.range(1).select(pages.safe_filename(F.lit(name)).alias("n")).first().n == want


def test_manifest(spark):
    rows = [(1, "a.PDF", "application/x-pdf", pages.MAX_BYTES), (1, "a.txt", None, 1), (1, "a.pdf", "text/html", 1), (1, "a.pdf", None, pages.MAX_BYTES + 1), (2, "a.pdf", None, 1)]
    df = spark.createDataFrame(rows, "project_id long, original_filename string, mime_type string, file_size_bytes long")
    got = pages.validate_manifest(df, spark.createDataFrame([(1,)], "id long")).orderBy("project_id", F.desc("file_size_bytes")).collect()
    assert sum(r.problem is None for r in got) == 1 and len({r.problem for r in got}) == 5


def test_status_and_updates(spark):
    df = spark.createDataFrame([(1, "a b c", None), (2, " ".join("abcdefghijkl"), None), (3, None, " bad ")], "document_id long, raw_text string, extraction_error string")
    got = {r.document_id: (r.status, r.word_count, r.status_message) for r in metadata.derive_status(df).collect()}
    assert got == {1: ("ocr_needed", 3, metadata.OCR_MESSAGE), 2: ("processed", 12, None), 3: ("extraction_failed", None, "bad")}


def test_overview_is_tolerant(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "processed", 2, 9, "one\n\n two", None), (2, "b.pdf", "odd", None, None, None, "w")], "document_id long, original_filename string, status string, page_count int, word_count int, extraction_error string, cleaning_warnings string")
    chunks = spark.createDataFrame([(1, 0), (1, 1)], "document_id long, chunk_index int")
    good = json.dumps([{"section_name": "A", "detected_heading": " H ", "confidence": 2.5}, 7, {"confidence": "x"}])
    log = spark.createDataFrame([(1, 1, "section_detection", "[]", 5), (2, 1, "section_detection", good, 5), (3, 2, "section_detection", "{broken", 9)], "id long, document_id long, analysis_type string, content string, created_at long")
    got = {r.document_id: r for r in metadata.document_overview(docs, chunks, log).collect()}
    assert [(s.section_name, s.detected_heading, s.confidence) for s in got[1].detected_sections] == [("A", "H", 1.0), ("Unknown", "", 0.0)]
    assert got[1].extraction_warnings == ["one", "two"] and got[1].chunk_count == 2 and got[1].processing_summary.is_complete
    assert got[2].detected_sections == [] and got[2].processing_summary.message == "Document is currently in 'odd' status."


def test_listings(spark):
    p = spark.createDataFrame([(1, 1, 5), (2, 2, 6), (3, 1, 6)], "id long, user_id long, created_at long")
    assert [r.id for r in metadata.list_projects(p).collect()] == [3, 2, 1]
    assert [r.id for r in metadata.list_projects(p, 1).collect()] == [3, 1]


def test_replace_chunks(spark, tmp_path):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d")], "document_id long, chunk_index int, text string")
    new = spark.createDataFrame([(1, 0, "A")], old.schema)
    touched = spark.createDataFrame([(1,), (3,)], "document_id long")
    want = {(1, 0, "A"), (2, 0, "c")}
    assert {tuple(r) for r in analyses.replace_chunks(old, new, touched).collect()} == want
    path = str(tmp_path / "chunks")
    analyses.overwrite_chunks(old, old.select("document_id"), path)
    for _ in range(2):
        analyses.overwrite_chunks(new, touched, path)
    assert {tuple(r) for r in analyses.read_chunks(spark, path).collect()} == want


    analyses.compact_chunks(spark, path, str(tmp_path / "compact"))
    assert {tuple(r) for r in analyses.read_chunks(spark, str(tmp_path / "compact")).collect()} == want
    assert spark.read.parquet(str(tmp_path / "compact" / "chunks")).count() == 2


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, 10, "raw", "clean", 5), (2, 11, None, "", 6)], "project_id long, document_id long, raw_text string, cleaned_text string, x int")
    analyses.write_texts(texts, str(tmp_path / "texts"))
    assert sorted(p.name for p in (tmp_path / "texts").iterdir() if p.is_dir()) == ["project_id=1", "project_id=2"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "texts")).select("project_id", "document_id", "raw_text", "cleaned_text").collect()} == {(1, 10, "raw", "clean"), (2, 11, None, "")}
    rows = analyses.analysis_rows(texts, "section_detection", F.struct("document_id", "raw_text"), F.lit("Title"))
    for _ in range(2):
        analyses.append_analyses(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {(r.title, r.analysis_type, json.loads(r.content)["raw_text"]) for r in log.collect()} == {("Title", "section_detection", "raw"), ("Title", "section_detection", None)}
    chat = spark.createDataFrame([(1, 10, "q", "a", "local", 7)], "project_id long, document_id long, question string, answer string, provider_mode string, question_id long")
    analyses.append_chat(chat, str(tmp_path / "chat"))
    assert [(r.question, r.answer, r.provider_mode) for r in spark.read.parquet(str(tmp_path / "chat")).collect()] == [("q", "a", "local")]


def test_stored_content_is_read_strictly(spark):
    rows = [(1, 5, "t", '{"a": 1}', 1), (2, 5, "t", '{"a": 2}', 2), (3, 6, "t", "not json", 1), (4, 6, "other", "[]", 2)]
    log = spark.createDataFrame(rows, "id long, document_id long, analysis_type string, content string, created_at long")
    assert [(r.document_id, r.content.a) for r in stored.read_latest(log.where("document_id = 5"), "t", "a int").collect()] == [(5, 2)]
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed|FAILFAST"):
        stored.read_latest(log, "t", "a int").collect()


def test_stream_replaces_documents(spark, tmp_path):
    inbox, store = str(tmp_path / "inbox"), str(tmp_path / "chunks")
    row = lambda d, t, at: (d, t, 1, None, at)
    for rows in ([row(1, "Abstract\nfirst words", 1), row(2, "Abstract\nother words", 1)], [row(1, "Abstract\nsecond words", 2)]):
        df = spark.createDataFrame(rows, "document_id long, raw_text string, page_count int, extraction_error string, arrived_at long")
        df.withColumn("arrived_at", F.timestamp_seconds("arrived_at")).coalesce(1).write.mode("append").parquet(inbox)
        ingest.ingest_stream(spark, inbox, store, str(tmp_path / "state")).awaitTermination()
    got = {(r.document_id, r.text) for r in analyses.read_chunks(spark, store).where("section_name = 'Abstract'").collect()}
    assert got == {(1, "second words"), (2, "other words")}
