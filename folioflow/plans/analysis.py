"""Registered queries: keywords, statistics, summaries, research information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import chunking, keywords, research, sections, statistics, stored, summaries
from folioflow.plans.ingest import SPACE, chunks_sql, line_list_sql, paper_chunks, sectioned_papers, sections_sql, strip_sql, words_sql
from folioflow.plans.papers import papers
from folioflow.sources.shared import documents, scratch


def keywords_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return keywords.extract_keywords(docs.select(F.col("doc_id").alias("document_id"), "text"), "document_id")


def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.explode_sections(sectioned_papers(spark, sf_dir), "document_id")


def _sections_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as a table, for what reads them more than once: cleaning and cutting cost far more than a read."""
    return scratch(paper_sections(spark, sf_dir).select("document_id", "section_pos", "section_type", "section_name", "confidence", "text"), "sections")


def _sectioned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of papers with their arrays of sections."""
    return scratch(sectioned_papers(spark, sf_dir, 40).select("document_id", "project_id", "page_count", "cleaned_text", "sections"), "sectioned")


def words_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.words_by_section(paper_sections(spark, sf_dir))


def chunks_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.chunks_by_section(paper_chunks(spark, sf_dir))


def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sectioned_papers(spark, sf_dir)
    out = out.withColumn("_text", statistics.reference_text(F.col("sections"), F.col("cleaned_text")))
    return out.select("document_id", statistics.reference_count(F.col("_text")).alias("reference_count"))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    return statistics.readability(docs, "text").drop("text")


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sectioned_once(spark, sf_dir)
    out = statistics.document_statistics(rows, chunking.split_sections_into_chunks(rows))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumns({c: flat(c) for c in ("word_count_by_section", "chunk_count_by_section")})


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.summarize_sections(paper_sections(spark, sf_dir), "document_id")
    return out.select(
        "document_id", "section_pos", "section_type", "summary", "selected_sentence_count",
        F.array_join(F.transform("source_sentence_indexes", lambda i: i.cast("string")), ",").alias("sentence_indexes"),
        summaries.summary_confidence().alias("confidence"), F.array_join(summaries.summary_limitations(), "|").alias("limitations"),
    )


def best_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.best_summaries(summaries.summarize_sections(paper_sections(spark, sf_dir), "document_id"), "document_id")
    return out.select("document_id", "position", "section_type", "section_pos", "summary", "selected_sentence_count", "confidence")


def research_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = research.extract_research_information(paper_sections(spark, sf_dir), "document_id")
    return out.withColumn("matched_keywords", F.array_join("matched_keywords", ","))


def research_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    items = research.extract_research_information(paper_sections(spark, sf_dir), "document_id")
    return research.primary_fields(docs, items, "document_id")


def research_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sections_once(spark, sf_dir)
    items = research.extract_research_information(found, "document_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    return research.research_warnings(docs, found, items, "document_id").withColumn("warnings", F.array_join("warnings", "|"))


def _log(rows: DataFrame) -> DataFrame:
    """Rows as they come back from the log, with an older row of each document that doesn't count."""
    rows, id_ = scratch(rows, "log"), F.col("document_id").cast("long")  # read twice below
    new = rows.withColumns({"id": 2 * id_ + 1, "created_at": F.lit(1)})
    return new.unionByName(new.withColumns({"id": 2 * id_, "content": F.lit("not json"), "created_at": F.lit(0)}))


def stored_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of papers, stored as JSON and read back strictly."""
    rows = _sectioned_once(spark, sf_dir)
    words = keywords.extract_keywords(rows, "document_id", "cleaned_text")
    numbers = statistics.document_statistics(rows, chunking.split_sections_into_chunks(rows))
    named = rows.select("document_id", "project_id", F.concat(F.lit("paper "), F.col("document_id").cast("string")).alias("original_filename"))
    log = _log(stored.overview_rows(named, words, numbers))
    c = stored.read_latest(log, stored.OVERVIEW[0], stored.OVERVIEW_SCHEMA).select("title", "content.*").select("*", "statistics.*", "statistics.readability.*")
    return c.select(
        "document_id", "title", "filename", F.array_join(F.transform("keywords", lambda k: F.concat_ws("=", k["keyword"], k["frequency"].cast("string"))), ",").alias("keywords"),
        "total_word_count", "reference_count_estimate", "sentence_count", "flesch_reading_ease",
    )


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section summaries of papers, stored as JSON and read back strictly."""
    docs = papers(spark, sf_dir).select("document_id", "project_id")
    log = _log(stored.summary_rows(docs, _sections_once(spark, sf_dir)))
    c = stored.read_latest(log, stored.SUMMARIES[0], stored.SUMMARIES_SCHEMA).select("content.*")
    texts = F.array_join(F.transform("summaries", lambda s: F.concat_ws("=", s["section_type"], s["summary"])), "|")
    return c.select("document_id", F.array_join("limitations", "|").alias("limitations"), F.array_join("source_section_names", "|").alias("names"), texts.alias("summaries"))


def stored_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research information of papers, stored as JSON and read back strictly."""
    docs = papers(spark, sf_dir).select("document_id", "project_id", F.concat(F.lit("paper "), F.col("document_id").cast("string")).alias("original_filename"))
    found = _sections_once(spark, sf_dir)
    items = scratch(research.extract_research_information(found, "document_id"), "items")
    log = _log(stored.research_rows(docs, found, items))
    c = stored.read_latest(log, stored.RESEARCH[0], stored.RESEARCH_SCHEMA).select("content.*")
    return c.select("document_id", "filename", F.array_join("warnings", "|").alias("warnings"), F.explode("fields").alias("field", "f")).select(
        "document_id", "filename", "warnings", "field", "f.extracted_text", "f.source_section", "f.confidence"
    )


def research_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research information of texts without sections."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    out = research.extract_research_information(stored.whole_text_sections(docs, "document_id"), "document_id")
    return out.withColumn("matched_keywords", F.array_join("matched_keywords", ","))


QUERIES = (
    stored_overviews, stored_summaries, stored_research, research_free_text, keywords_per_document, words_by_section, chunks_by_section, reference_counts, readability, document_statistics,
    section_summaries, best_summaries, research_items, research_primary, research_warnings,
)


def ascii_sql(x: str) -> str:
    """Letters and digits outside ASCII as underscores, other characters outside it as spaces: then RE2's ASCII word
    boundaries stand where the Unicode ones do."""
    return rf"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


WORD = r"\b[a-zA-Z][a-zA-Z''-]*\b"


def analysis_words_sql(x: str) -> str:
    return f"regexp_extract_all({ascii_sql(x)}, '{WORD}')"


def keyword_tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in keywords.STOP_WORDS)
    tokens = rf"list_transform(regexp_extract_all({ascii_sql(f'lower({x})')}, '\b[a-zA-Z][a-zA-Z-]{{2,}}\b'), lambda t: trim(t, '-'))"
    return f"list_filter({tokens}, lambda t: length(t) >= 3 AND t NOT IN ({stop}))"


def sentences_sql(x: str) -> str:
    """Raw sentences; a dot between digits is protected twice over, as captures don't overlap."""
    once = lambda y: rf"regexp_replace({y}, '(\p{{Nd}})\.(\p{{Nd}})', '\1<DOT>\2', 'g')"
    return rf"list_transform(regexp_extract_all({once(once(x))}, '[^.!?]+[.!?]?'), lambda s: replace(s, '<DOT>', '.'))"


def _name_sql() -> str:
    return "CASE WHEN trim(section_name) = '' THEN 'Unknown' ELSE trim(section_name) END AS section_name"


def half_even_sql(n: str, d: str) -> str:
    low = f"({n} * 100) // {d}"
    twice = f"2 * (({n} * 100) - {low} * {d})"
    return f"({low} + CASE WHEN {twice} > {d} OR ({twice} = {d} AND ({low}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"


_ENTRY = r"(?i)^\s*(?:\[\p{Nd}+\]|\p{Nd}+[.)]|[\p{L}\p{N}_][\p{L}\p{N}_''-]+,\s+(?:[A-Z]\.\s*)+|[\p{L}\p{N}_][\p{L}\p{N}_''-]+\s+et\s+al\.)"
_SYLLABLES = r"""list_sum(list_transform(ws, lambda w: CASE WHEN regexp_replace(lower(w), '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1,
  len(regexp_extract_all(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[aeiouy]+'))
  - CASE WHEN regexp_replace(lower(w), '[^a-z]', '', 'g') LIKE '%e' AND len(regexp_extract_all(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END))"""


def readability_sql(source: str, text: str) -> str:
    return rf"""SELECT document_id, CAST(ns AS INTEGER) AS sentence_count, coalesce(a, 0.0::DOUBLE) AS average_words_per_sentence, coalesce(b, 0.0::DOUBLE) AS average_syllables_per_word,
    CASE WHEN a IS NOT NULL THEN round((20683500 - 1015 * CAST(round(a * 100) AS BIGINT) - 84600 * CAST(round(b * 100) AS BIGINT)) / 1000.0::DOUBLE) / 100.0::DOUBLE END AS flesch_reading_ease
  FROM (SELECT *, CASE WHEN n > 0 AND ns > 0 THEN {half_even_sql("n", "ns")} END AS a, CASE WHEN n > 0 AND ns > 0 THEN {half_even_sql("syl", "n")} END AS b FROM (
    SELECT *, len(ws) AS n, CAST({_SYLLABLES} AS BIGINT) AS syl FROM (SELECT document_id, {analysis_words_sql(text)} AS ws,
      len(list_filter({sentences_sql(text)}, lambda s: len({analysis_words_sql("s")}) > 0)) AS ns FROM {source})))"""


_CLEAN_UNIT = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^\s*(?:[-*]|\p{{Nd}}+[.)]|[A-Z]{{1,4}}\p{{Nd}}*[:.)])\s*', ''), '{SPACE}+', ' ', 'g'), '^[ :-]+', ''), '[ :-]+$', '')"  # noqa: E731, E501


def _clean_sentence_sql(x: str) -> str:
    plain = strip_sql(rf"regexp_replace(regexp_replace({x}, 'https?://[^\s\x{{85}}\p{{Z}}\x1c-\x1f]+', '', 'g'), '{SPACE}+', ' ', 'g')")
    openers = "|".join(summaries.OPENERS)
    rest = rf"regexp_extract({plain}, '^\s*\p{{Nd}}+(?:\.\p{{Nd}}+)+\s+.+?\b((?:{openers})\s+[a-z].*)$', 1)"
    return f"CASE WHEN len({analysis_words_sql(rest)}) >= 6 THEN {strip_sql(rest)} ELSE {plain} END"


def research_sql(period: int = 3, given: str = "") -> str:
    """Common table expressions up to `items`; `given` defines other `sections` than those of papers."""
    fields = []
    for field, (wanted, words) in research.RULES.items():
        found = ", ".join(rf"CASE WHEN regexp_matches(la, '\b{k}\b') THEN '{k}' END" for k in words)
        hits = f"list_filter([{found}], lambda k: k IS NOT NULL)"
        if "question" in words:
            hits = f"CASE WHEN contains(unit, '?') AND NOT list_contains({hits}, 'question') THEN list_append({hits}, 'question') ELSE {hits} END"
        fields.append(f"SELECT *, '{field}' AS field, section_type IN ({', '.join(map(repr, wanted))}) AS preferred, {hits} AS hits FROM units")
    sentences = rf"list_transform(list_filter({sentences_sql('c')}, lambda s: len({analysis_words_sql('s')}) > 0), lambda s: {_clean_sentence_sql('s')})"
    return rf"""{given or sections_sql(period)},
unit_lines AS (SELECT document_id, section_pos, section_type, section_name, unnest(ls) AS l, generate_subscripts(ls, 1) AS li FROM (SELECT *, {line_list_sql("text")} AS ls FROM sections)),
unit_clean AS (SELECT *, {_CLEAN_UNIT("l")} AS c FROM unit_lines),
unit_sents AS (SELECT *, {sentences} AS ss FROM unit_clean WHERE len({analysis_words_sql("c")}) > 0),
unit_raw AS (SELECT document_id, section_pos, section_type, section_name, li, unnest(us) AS u, generate_subscripts(us, 1) AS ui FROM (SELECT *, CASE WHEN len(ss) <= 1 AND length(c) <= 180 AND (contains(c, ':') OR c LIKE '%?'
    OR regexp_matches({strip_sql("l")}, '(?i)^(?:RQ|H)\p{{Nd}}+')) THEN [c] ELSE ss END AS us FROM unit_sents)),
units AS (SELECT *, {ascii_sql("lower(unit)")} AS la FROM (SELECT document_id, section_pos, section_type, section_name, li, ui, {_CLEAN_UNIT("u")} AS unit FROM unit_raw WHERE len({analysis_words_sql("u")}) > 0)),
fields AS ({" UNION ALL ".join(fields)}),
accepted AS (SELECT *, least(95, 35 + CASE WHEN preferred THEN 25 ELSE 0 END + least(10 * len(hits), 30) + CASE WHEN contains(unit, ':') OR contains(unit, '?') THEN 5 ELSE 0 END) / 100.0::DOUBLE AS confidence
  FROM fields WHERE len(hits) > 0 OR (field = 'methodology' AND preferred)
  QUALIFY row_number() OVER (PARTITION BY document_id, field, trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')) ORDER BY section_pos, li, ui) = 1),
items AS (SELECT document_id, field, CAST(row_number() OVER (PARTITION BY document_id, field ORDER BY confidence DESC, section_name, unit) AS INTEGER) AS rank, unit AS extracted_text,
    section_name AS source_section, confidence, array_to_string(hits, ',') AS matched_keywords FROM accepted QUALIFY rank <= 3)"""


def _candidate_sql(s: str) -> str:
    """Whether sentence s can stand in a summary."""
    low = f"lower({s})"
    bad = [rf"regexp_matches({s}, '^[,;:)\]]')", rf"regexp_matches({ascii_sql(low)}, '\bfigure\s+x\b')"]
    bad += [f"contains({low}, '{x}')" for x in summaries.PLACEHOLDERS] + [f"starts_with({low}, '{x}')" for x in summaries.CAPTIONS]
    bad += [rf"regexp_matches({ascii_sql(s)}, '(?i)\b(?:doi\b|org\b|https?://\b|www\.\b)')"]
    bad += [rf"len(regexp_extract_all({ascii_sql(s)}, '\b[0-9]+(?:\.[0-9]+)+\s+[A-Z]')) >= 2"]
    bad += [f"length({s}) - length(replace({s}, '{mark}', '')) >= 2" for mark in summaries.BULLETS]
    bad += [rf"regexp_matches({s}, '^\s*\p{{Nd}}+(?:\.\p{{Nd}}+)+\s+\S+(?:\s+\S+){{0,5}}\s*$')"]
    return f"(len({analysis_words_sql(s)}) >= 3 AND NOT ({' OR '.join(bad)}))"


def summaries_sql(source: str, max_words: int = 90, most: int = 2) -> str:
    """Common table expressions up to `summed` from (document_id, section_pos, section_type, confidence, text) rows."""
    cleaned = rf"list_transform(list_filter({sentences_sql('text')}, lambda s: len({analysis_words_sql('s')}) > 0), lambda s: {_clean_sentence_sql('s')})"
    fits = f"acc.u + x.u <= {max_words}"
    return rf"""wanted AS (SELECT document_id, section_pos, section_type, confidence, text FROM {source} WHERE section_type IN ({", ".join(map(repr, summaries.SECTION_TYPES))})),
frequencies AS (SELECT document_id, section_pos, token, count(*) AS f FROM (SELECT document_id, section_pos, unnest({keyword_tokens_sql("text")}) AS token FROM wanted) GROUP BY ALL),
said AS (SELECT document_id, section_pos, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT document_id, section_pos, {cleaned} AS ss FROM wanted)),
said_tokens AS (SELECT document_id, section_pos, i, unnest({keyword_tokens_sql("s")}) AS token FROM said),
said_scores AS (SELECT document_id, section_pos, i, round(sum(coalesce(f, 0)) / count(*)::DOUBLE + 0.1 / (i + 1), 6) AS score
  FROM said_tokens LEFT JOIN frequencies USING (document_id, section_pos, token) GROUP BY document_id, section_pos, i),
ranked AS (SELECT document_id, section_pos, list({{'u': len({analysis_words_sql("s")}), 'p': [i], 't': [s]}} ORDER BY coalesce(score, 0) DESC, i) AS c
  FROM said LEFT JOIN said_scores USING (document_id, section_pos, i) WHERE {_candidate_sql("s")} GROUP BY document_id, section_pos),
taken AS (SELECT document_id, section_pos, list_reduce(list_concat([{{'u': 0::BIGINT, 'p': []::BIGINT[], 't': []::VARCHAR[]}}], c),
    lambda acc, x: CASE WHEN {fits} THEN {{'u': acc.u + x.u, 'p': list_concat(acc.p, x.p), 't': list_concat(acc.t, x.t)}} ELSE acc END) AS r FROM ranked),
picked AS (SELECT document_id, section_pos, list_sort(list_zip(r.p[:{most}], r.t[:{most}])) AS z FROM taken),
summed AS (SELECT *, CASE WHEN summary = '' THEN 0.0::DOUBLE ELSE round_even(round(sure * 75 + least(selected_sentence_count, 2) * 12.5, 6), 0) / 100.0::DOUBLE END AS confidence FROM (
  SELECT document_id, section_pos, section_type, w.confidence AS sure, {strip_sql("coalesce(array_to_string(list_transform(z, lambda x: x[2]), ' '), '')")} AS summary,
    CAST(coalesce(len(z), 0) AS INTEGER) AS selected_sentence_count, coalesce(array_to_string(list_transform(z, lambda x: CAST(x[1] AS VARCHAR)), ','), '') AS sentence_indexes
  FROM wanted w LEFT JOIN picked USING (document_id, section_pos)))"""


REFERENCES = rf"""refs AS (SELECT c.document_id, coalesce(nullif(string_agg(s.text, chr(10) ORDER BY s.section_pos), ''), any_value(c.cleaned_text)) AS t
  FROM cleaned c LEFT JOIN sections s ON s.document_id = c.document_id AND (section_type = 'references' OR lower(section_name) IN ('references', 'bibliography')) GROUP BY c.document_id),
reference_counts AS (SELECT document_id, CAST(coalesce(nullif(len(list_filter({line_list_sql("t")}, lambda l: regexp_matches({strip_sql("l")}, '{_ENTRY}'))), 0),
  len(regexp_extract_all(t, '\([A-Z][A-Za-z''-]+,\s*(?:19|20)\p{{Nd}}{{2}}\)'))) AS INTEGER) AS reference_count FROM refs)"""
_TEXTS = f"""sections AS (SELECT doc_id AS document_id, 0 AS section_pos, 'unknown' AS section_type, 'Full Document' AS section_name, text FROM documents
  WHERE {strip_sql("coalesce(text, '')")} <> '')"""
_FIELDS = ", ".join(f"('{f}')" for f in research.RULES)
SQL: dict[str, str] = {
    "keywords_per_document": f"""WITH tokens AS (SELECT doc_id AS document_id, unnest({keyword_tokens_sql("text")}) AS keyword FROM documents),
counts AS (SELECT document_id, keyword, CAST(count(*) AS INTEGER) AS frequency FROM tokens GROUP BY ALL),
scored AS (SELECT *, round(frequency / (sum(frequency) OVER (PARTITION BY document_id))::DOUBLE * (1 + ln(frequency)), 6) AS score FROM counts)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY score DESC, frequency DESC, keyword) AS INTEGER) AS rank, keyword, score, frequency FROM scored QUALIFY rank <= 10""",
    "words_by_section": f"WITH {sections_sql()} SELECT document_id, {_name_sql()}, CAST(sum(len({analysis_words_sql('text')})) AS BIGINT) AS word_count FROM sections GROUP BY ALL",
    "chunks_by_section": f"WITH {sections_sql(40)}, {chunks_sql('sections')} SELECT document_id, section_name, count(*) AS chunk_count FROM chunks GROUP BY ALL",
    "reference_counts": f"WITH {sections_sql()}, {REFERENCES} SELECT * FROM reference_counts",
    "document_statistics": f"""WITH {sections_sql(40)}, {chunks_sql("sections")}, {REFERENCES},
own AS (SELECT document_id, section_name, sum(len({analysis_words_sql("text")})) AS n FROM (SELECT document_id, text, {_name_sql()} FROM sections) GROUP BY ALL),
wm AS (SELECT document_id, string_agg(section_name || '=' || n, ',' ORDER BY section_name) AS word_count_by_section FROM own GROUP BY 1),
held AS (SELECT document_id, section_name, count(*) AS n FROM chunks GROUP BY ALL),
cm AS (SELECT document_id, string_agg(section_name || '=' || n, ',' ORDER BY section_name) AS chunk_count_by_section FROM held GROUP BY 1),
rd AS ({readability_sql("cleaned", "cleaned_text")})
SELECT c.document_id, CAST(len({analysis_words_sql("cleaned_text")}) AS INTEGER) AS total_word_count, word_count_by_section, coalesce(chunk_count_by_section, '') AS chunk_count_by_section,
  reference_count AS reference_count_estimate, sentence_count, average_words_per_sentence, average_syllables_per_word, flesch_reading_ease
FROM cleaned c JOIN wm USING (document_id) LEFT JOIN cm USING (document_id) JOIN reference_counts USING (document_id) JOIN rd USING (document_id)""",
    "readability": readability_sql("(SELECT doc_id AS document_id, coalesce(text, '') AS text FROM documents)", "text"),
    "research_items": f"WITH {research_sql()} SELECT * FROM items",
    "research_primary": f"""WITH {research_sql()} SELECT d.document_id, f.field, extracted_text, source_section, coalesce(confidence, 0.0::DOUBLE) AS confidence
FROM (SELECT doc_id AS document_id FROM documents) d CROSS JOIN (VALUES {_FIELDS}) f(field) LEFT JOIN items i ON i.document_id = d.document_id AND i.field = f.field AND i.rank = 1""",
    "research_warnings": f"""WITH {research_sql()}, has_text AS (SELECT DISTINCT document_id FROM sections WHERE {strip_sql("text")} <> ''), hit AS (SELECT DISTINCT document_id FROM items)
SELECT doc_id AS document_id, CASE WHEN s.document_id IS NULL THEN '{research.NO_TEXT}' WHEN h.document_id IS NULL THEN '{research.NO_PATTERN}' ELSE '' END AS warnings
FROM documents d LEFT JOIN has_text s ON s.document_id = d.doc_id LEFT JOIN hit h ON h.document_id = d.doc_id""",
    "section_summaries": f"""WITH {sections_sql()}, {summaries_sql("sections")} SELECT document_id, CAST(section_pos AS INTEGER) AS section_pos, section_type, summary, selected_sentence_count, sentence_indexes, confidence,
  concat_ws('|', '{summaries.ALWAYS}', CASE WHEN sure < 0.8 THEN '{summaries.UNSURE}' END, CASE WHEN summary = '' THEN '{summaries.NOTHING}' WHEN selected_sentence_count < 2 THEN '{summaries.SHORT}' END) AS limitations FROM summed""",
    "best_summaries": f"""WITH {sections_sql()}, {summaries_sql("sections")},
best AS (SELECT *, min(section_pos) OVER (PARTITION BY document_id, section_type) AS first FROM summed WHERE summary <> ''
  QUALIFY row_number() OVER (PARTITION BY document_id, section_type ORDER BY selected_sentence_count DESC, confidence DESC, {words_sql("summary")} DESC, section_pos) = 1)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY first) AS INTEGER) AS position, section_type, CAST(section_pos AS INTEGER) AS section_pos, summary, selected_sentence_count, confidence FROM best""",
    "research_free_text": f"WITH {research_sql(given=_TEXTS)} SELECT * FROM items",
    "stored_overviews": f"""WITH {sections_sql(40)}, {REFERENCES}, rd AS ({readability_sql("cleaned", "cleaned_text")}),
kt AS (SELECT document_id, unnest({keyword_tokens_sql("cleaned_text")}) AS keyword FROM cleaned), kc AS (SELECT document_id, keyword, count(*) AS f FROM kt GROUP BY ALL),
ks AS (SELECT *, round(f / (sum(f) OVER (PARTITION BY document_id))::DOUBLE * (1 + ln(f)), 6) AS score FROM kc),
kr AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, f DESC, keyword) AS rank FROM ks QUALIFY rank <= 10),
kl AS (SELECT document_id, string_agg(keyword || '=' || f, ',' ORDER BY rank) AS keywords FROM kr GROUP BY 1)
SELECT c.document_id, '{stored.OVERVIEW[1]}' AS title, 'paper ' || c.document_id AS filename, coalesce(keywords, '') AS keywords, CAST(len({analysis_words_sql("cleaned_text")}) AS INTEGER) AS total_word_count,
  reference_count AS reference_count_estimate, sentence_count, flesch_reading_ease
FROM cleaned c JOIN reference_counts USING (document_id) JOIN rd USING (document_id) LEFT JOIN kl USING (document_id)""",
    "stored_summaries": f"""WITH {sections_sql()}, {summaries_sql("sections")},
best AS (SELECT s.*, min(s.section_pos) OVER (PARTITION BY s.document_id, s.section_type) AS first FROM summed s WHERE summary <> ''
  QUALIFY row_number() OVER (PARTITION BY document_id, section_type ORDER BY selected_sentence_count DESC, confidence DESC, {words_sql("summary")} DESC, section_pos) = 1),
joined AS (SELECT b.document_id, string_agg(section_name, '|' ORDER BY first) AS names, string_agg(b.section_type || '=' || summary, '|' ORDER BY first) AS summaries
  FROM best b JOIN sections n ON n.document_id = b.document_id AND n.section_pos = b.section_pos GROUP BY b.document_id)
SELECT p.document_id, CASE WHEN p.document_id NOT IN (SELECT document_id FROM sections) THEN '{stored.NO_SECTIONS}' WHEN summaries IS NULL THEN '{stored.EXTRACTIVE}|{stored.NO_SUMMARIES}' ELSE '{stored.EXTRACTIVE}' END AS limitations,
  coalesce(names, '') AS names, coalesce(summaries, '') AS summaries FROM papers p LEFT JOIN joined USING (document_id)""",
    "stored_research": f"""WITH {research_sql()}, has_text AS (SELECT DISTINCT document_id FROM sections WHERE {strip_sql("text")} <> ''), hit AS (SELECT DISTINCT document_id FROM items)
SELECT d.document_id, 'paper ' || d.document_id AS filename, CASE WHEN s.document_id IS NULL THEN '{research.NO_TEXT}' WHEN h.document_id IS NULL THEN '{research.NO_PATTERN}' ELSE '' END AS warnings,
  f.field, extracted_text, source_section, coalesce(confidence, 0.0::DOUBLE) AS confidence
FROM papers d CROSS JOIN (VALUES {_FIELDS}) f(field) LEFT JOIN items i ON i.document_id = d.document_id AND i.field = f.field AND i.rank = 1
LEFT JOIN has_text s ON s.document_id = d.document_id LEFT JOIN hit h ON h.document_id = d.document_id""",
}
