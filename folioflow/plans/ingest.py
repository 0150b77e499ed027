"""Registered queries: cleaning, sections, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.operators import chunking, cleaning, sections
from folioflow.plans.papers import papers, papers_sql
from folioflow.sources.shared import spread


def cleaned_papers(spark: SparkSession, sf_dir: str, period: int = 3) -> DataFrame:
    return cleaning.clean_text(papers(spark, sf_dir, period), "raw_text")


def sectioned_papers(spark: SparkSession, sf_dir: str, period: int = 3) -> DataFrame:
    return sections.detect_sections(cleaned_papers(spark, sf_dir, period))


def paper_chunks(spark: SparkSession, sf_dir: str, period: int = 40) -> DataFrame:
    return chunking.split_sections_into_chunks(sectioned_papers(spark, sf_dir, period))


def clean_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.run_text_cleaning(papers(spark, sf_dir), "raw_text")
    counts = [c for c in out.columns if c.endswith("_count") and c != "page_count"]
    return out.select("document_id", *counts, F.array_join("cleaning_warnings", "|").alias("warnings"))


def basic_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cleaning.normalize_whitespace(cleaning.repair_hyphenated_line_breaks(cleaning.remove_control_characters(F.col("raw_text"))))
    return papers(spark, sf_dir).select("document_id", c.alias("basic_text"))


def repeated_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = basic_cleaning(spark, sf_dir).withColumnRenamed("basic_text", "artifact_free_text")
    return cleaning.remove_repeated_artifacts(out, "artifact_free_text")


def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_papers(spark, sf_dir).select("document_id", "cleaned_text")


def classify_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.exploded(cleaned_papers(spark, sf_dir), T.lines(F.col("cleaned_text")), "line_no", "line", "document_id")
    out = lines.select("document_id", "line_no", sections.classify_heading(T.strip(F.col("line"))).alias("section_type"), sections.is_probable_title(F.col("line")).alias("title_like"))
    return out.where("section_type is not null or line_no = 0")


def detect_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.explode_sections(sectioned_papers(spark, sf_dir), "document_id")


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_chunks(spark, sf_dir)


def document_chunks(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, where: str = "true") -> DataFrame:
    """Chunks of whole documents as single unknown sections; only of the documents in `of` (document_id) if given, and of
    rows that meet a condition, which moves nothing."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where(where))
    if of is not None:
        docs = docs.join(of.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
    one = F.array(F.struct(F.lit(" ").alias("section_name"), F.col("text").alias("text")))
    rows = docs.select(F.col("doc_id").alias("document_id"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 3000)).cast("int").alias("page_count"), one.alias("sections"))
    return chunking.split_sections_into_chunks(rows)


QUERIES = (
    basic_cleaning, repeated_artifacts, cleaned_text, clean_statistics, classify_headings, detect_sections, section_chunks,
    document_chunks,
)

# SQL. RE2 has no look-around and an ASCII \b, so captures and stand-ins take their place.

SPACE = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]"
WORD_CHAR = r"[\p{L}\p{N}_]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def squeeze_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def split_words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"


def normalize_sql(x: str) -> str:
    unified = rf"regexp_replace({x}, '\r\n|\r', chr(10), 'g')"
    lines = rf"list_transform(string_split({unified}, chr(10)), lambda l: {strip_sql(chr(114) + 'egexp_replace(l, ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})"
    return strip_sql(rf"regexp_replace(array_to_string({lines}, chr(10)), '\n\n\n+', chr(10) || chr(10), 'g')")


def _heading_sql(x: str) -> str:
    plain = squeeze_sql(rf"regexp_replace(regexp_replace(lower({strip_sql(x)}), '^\p{{Nd}}+(?:\.\p{{Nd}}+)*[.)]?\s+', ''), '[^a-z0-9 &/-]+', '', 'g')")
    return f"{plain} IN ({', '.join(repr(h) for h in cleaning.HEADINGS)})"


LIST_ITEM = r"^(\p{Nd}+[.)]|[A-Za-z][.)]|[-*\x{2022}])\s+"


def cleaning_sql(period: int = 3) -> str:
    """Common table expressions papers, basic, artifact_free, cleaned."""
    control = r"regexp_replace(raw_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    hyphen = rf"regexp_replace({control}, '({WORD_CHAR})-{SPACE}*\n{SPACE}*({WORD_CHAR})', '\1\2', 'g')"
    joins = rf"""NOT ({_heading_sql("cur")} OR {_heading_sql("x")} OR regexp_matches(cur, '{LIST_ITEM}') OR regexp_matches(x, '{LIST_ITEM}')
      OR regexp_matches(cur, '[.!?:;]$') OR (regexp_matches(x, '^\p{{Lu}}') AND len({split_words_sql("cur")}) <= 6))"""
    cur = "regexp_extract(acc, '[^\\n]*$')"
    fold = joins.replace("cur", cur)
    return rf"""{papers_sql(period)},
basic AS (SELECT *, {normalize_sql(hyphen)} AS basic_text FROM papers),
line_counts AS (SELECT document_id, lower(l) AS k, count(*) AS n FROM (SELECT document_id, unnest(string_split(basic_text, chr(10))) AS l FROM basic) GROUP BY ALL),
numbered AS (SELECT document_id, unnest(string_split(basic_text, chr(10))) AS l, generate_subscripts(string_split(basic_text, chr(10)), 1) AS i FROM basic),
artifact_free AS (
  SELECT b.*, {strip_sql("coalesce(t, '')")} AS artifact_free_text FROM basic b LEFT JOIN (
    SELECT document_id, string_agg(l, chr(10) ORDER BY i) AS t FROM numbered JOIN line_counts USING (document_id)
    WHERE k = lower(l) AND (l = '' OR NOT (regexp_matches(l, '(?i)^(?:page\s*)?\p{{Nd}}+(?:\s*(?:of|/)\s*\p{{Nd}}+)?$')
      OR (n >= 3 AND length(l) <= 120 AND NOT regexp_matches(l, '[.?!]$') AND len({split_words_sql("l")}) <= 10)))
    GROUP BY document_id) USING (document_id)),
cleaned AS (
  SELECT *, {normalize_sql("joined_text")} AS cleaned_text FROM (SELECT *, array_to_string(list_filter(list_transform(string_split(artifact_free_text, chr(10) || chr(10)),
    lambda p: list_reduce(list_filter(list_transform(string_split(p, chr(10)), lambda l: {strip_sql("l")}), lambda l: l <> ''),
      lambda acc, x: acc || CASE WHEN {fold} THEN ' ' ELSE chr(10) END || x, '' )), lambda p: p IS NOT NULL AND p <> ''), chr(10) || chr(10)) AS joined_text FROM artifact_free))"""


def line_list_sql(x: str) -> str:
    parts = r"regexp_split_to_array(coalesce(X, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')".replace("X", x)
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD_CHAR}+'))"


def kind_sql(line: str) -> str:
    """Section type of a stripped line."""
    plain = lambda c: rf"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 &/-]+', '', 'g'), '\s+', ' ', 'g')"
    heading = plain(f"trim(regexp_extract({line}, '{NUMBERED}', 1))")
    cases = " ".join(f"WHEN {heading} IN ({', '.join(map(repr, names))}) THEN '{kind}'" for kind, names in sections.ALIASES.items())
    chapters = " ".join(rf"WHEN regexp_matches({line}, '^\s*{n}(?:\.\p{{Nd}}+)+') THEN '{kind}'" for n, kind in sections.CHAPTERS.items())
    return f"""CASE WHEN regexp_matches({plain(line)}, '^(?:references|bibliography|works cited)') THEN 'references'
      WHEN NOT regexp_matches({line}, '{NUMBERED}') THEN NULL {cases}
      WHEN regexp_matches({heading}, '^(?:results of |findings from |findings of )') THEN 'results' {chapters} END"""


NUMBERED = r"^\s*(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?\s+)?([A-Za-z][A-Za-z &/-]{2,80})\s*:?\s*$"


def title_sql(line: str, kind: str) -> str:
    return rf"({line} <> '' AND length({line}) <= 180 AND {kind} IS NULL AND NOT regexp_matches({line}, '[.:;]$') AND regexp_matches({line}, '\p{{L}}'))"


def sections_sql(period: int = 3) -> str:
    """Common table expressions up to `sections`, one row per section."""
    return rf"""{cleaning_sql(period)},
raw_lines AS (SELECT document_id, page_count, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT *, {line_list_sql("cleaned_text")} AS ls FROM cleaned)),
lines AS (SELECT *, {kind_sql("s")} AS kind, sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i) - length(line) - 1 AS p0 FROM (SELECT *, {strip_sql("line")} AS s FROM raw_lines)),
grouped AS (SELECT *, count(kind) OVER (PARTITION BY document_id ORDER BY i) AS g FROM lines),
bodies AS (SELECT document_id, any_value(page_count) AS page_count, g, max(kind) AS section_type, min(s) FILTER (kind IS NOT NULL) AS heading,
    {strip_sql("coalesce(string_agg(rtrim(line), chr(10) ORDER BY i) FILTER (kind IS NULL), '')")} AS text,
    min(p0) AS start_index, arg_max(p0 + length(line), i) AS end_index, 0.95::DOUBLE AS confidence, min(i) AS start_line, max(i) AS end_line
  FROM grouped WHERE g > 0 GROUP BY document_id, g),
firsts AS (SELECT document_id, page_count, s, p0, i, line FROM lines WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i) = 1),
titles AS (SELECT document_id, page_count, 0 AS g, 'title' AS section_type, 'Title' AS heading, s AS text, p0 AS start_index, p0 + length(line) AS end_index, 0.75::DOUBLE AS confidence, i AS start_line, i AS end_line
  FROM firsts WHERE {title_sql("s", kind_sql("s"))}),
found AS (SELECT * FROM bodies UNION ALL BY NAME SELECT * FROM titles),
others AS (SELECT document_id, page_count, 0 AS g, 'unknown' AS section_type, 'Unknown' AS heading, {strip_sql("cleaned_text")} AS text, 0 AS start_index,
    CASE WHEN {strip_sql("cleaned_text")} = '' THEN 0 ELSE length(cleaned_text) END AS end_index, 0.0::DOUBLE AS confidence, 0 AS start_line,
    greatest(coalesce((SELECT max(i) FROM lines l WHERE l.document_id = c.document_id), 0), 0) AS end_line
  FROM cleaned c WHERE document_id NOT IN (SELECT document_id FROM found)),
sections AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY g) - 1 AS section_pos,
    array_to_string(list_transform(string_split(section_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS section_name
  FROM (SELECT * FROM found UNION ALL BY NAME SELECT * FROM others))"""


def chunks_sql(source: str, size: int = 700, overlap: int = 125) -> str:
    """Common table expressions up to `chunks` from (document_id, page_count, section_pos, section_name, text) rows;
    the final pair comes from a search over all allowed pairs."""
    step = size - overlap
    return rf"""worded AS (SELECT *, {split_words_sql("coalesce(text, '')")} AS ws FROM {source}),
sized AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) <= 849 THEN 0 ELSE CAST(greatest(0, ceil((len(ws) - {min(1500, 849 + step)}) / {step}.0)) AS INTEGER) END AS k FROM worded),
rests AS (SELECT DISTINCT n - k * {step} AS rest FROM sized WHERE n > 849),
pairs AS (SELECT rest, f, f - o AS second_start FROM rests, range(500, 801) a(f), range(100, 151) b(o)
  WHERE rest - f + o BETWEEN 500 AND 800
  QUALIFY row_number() OVER (PARTITION BY rest ORDER BY abs(f - {size}) + abs(rest - f + o - {size}) + abs(o - {overlap}), f, rest - f + o, o) = 1),
ranges AS (
  SELECT *, unnest(range(k)) * {step} AS b, unnest(range(k)) * {step} + {size} AS e FROM sized WHERE n > 849
  UNION ALL SELECT *, 0, n FROM sized WHERE n BETWEEN 1 AND 849
  UNION ALL SELECT s.*, k * {step}, k * {step} + coalesce(f, least({size}, n - k * {step})) FROM sized s LEFT JOIN pairs ON rest = n - k * {step} WHERE n > 849
  UNION ALL SELECT s.*, k * {step} + coalesce(second_start, least({size}, n - k * {step})), n FROM sized s LEFT JOIN pairs ON rest = n - k * {step} WHERE n > 849),
chunks AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section_pos, b) - 1 AS INTEGER) AS chunk_index,
    CASE WHEN trim(section_name) = '' THEN 'Unknown' ELSE trim(section_name) END AS section_name,
    CAST(least(greatest(floor((b / n::DOUBLE) * page_count) + 1, 1), page_count) AS INTEGER) AS page_start,
    CAST(least(greatest(ceil((e / n::DOUBLE) * page_count), least(greatest(floor((b / n::DOUBLE) * page_count) + 1, 1), page_count)), page_count) AS INTEGER) AS page_end,
    array_to_string(ws[b + 1:e], ' ') AS text, CAST(e - b AS INTEGER) AS word_count FROM ranges)"""


_REMOVED = "greatest(length(raw_text) - length(cleaned_text), 0)"
_WHOLE = """whole AS (SELECT doc_id AS document_id, CAST(greatest(1, ceil(n_chars / 3000.0)) AS INTEGER) AS page_count, 0 AS section_pos, ' ' AS section_name, text FROM documents)"""

SQL: dict[str, str] = {
    "basic_cleaning": f"WITH {cleaning_sql()} SELECT document_id, basic_text FROM basic",
    "repeated_artifacts": f"WITH {cleaning_sql()} SELECT document_id, artifact_free_text FROM artifact_free",
    "cleaned_text": f"WITH {cleaning_sql()} SELECT document_id, cleaned_text FROM cleaned",
    "clean_statistics": f"""WITH {cleaning_sql()} SELECT document_id, CAST(length(raw_text) AS INTEGER) AS original_character_count,
  CAST(length(cleaned_text) AS INTEGER) AS cleaned_character_count, CAST({_REMOVED} AS INTEGER) AS removed_character_count,
  CAST({words_sql("raw_text")} AS INTEGER) AS original_word_count, CAST({words_sql("cleaned_text")} AS INTEGER) AS cleaned_word_count,
  CAST(len({line_list_sql("raw_text")}) AS INTEGER) AS original_line_count, CAST(len({line_list_sql("cleaned_text")}) AS INTEGER) AS cleaned_line_count,
  concat_ws('|', CASE WHEN {strip_sql("raw_text")} = '' THEN '{cleaning.EMPTY_INPUT}' END,
    CASE WHEN {strip_sql("raw_text")} <> '' AND {strip_sql("cleaned_text")} = '' THEN '{cleaning.EMPTY_RESULT}' END,
    CASE WHEN 2 * {_REMOVED} > length(raw_text) THEN '{cleaning.LARGE_REDUCTION}' END) AS warnings FROM cleaned""",
    "classify_headings": f"""WITH {sections_sql()} SELECT document_id, CAST(i AS INTEGER) AS line_no, kind AS section_type, {title_sql("s", "kind")} AS title_like
  FROM lines WHERE kind IS NOT NULL OR i = 0""",
    "detect_sections": f"""WITH {sections_sql()} SELECT document_id, CAST(section_pos AS INTEGER) AS section_pos, section_type, section_name, heading, heading AS detected_heading, text,
  CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, confidence, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM sections""",
    "section_chunks": f"WITH {sections_sql(40)}, {chunks_sql('sections')} SELECT * FROM chunks",
    "document_chunks": f"WITH {_WHOLE}, {chunks_sql('whole')} SELECT * FROM chunks",
}
