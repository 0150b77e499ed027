"""Registered queries: search and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import qa, retrieval
from folioflow.operators.search_index import StoredIndex
from folioflow.plans.analysis import ascii_sql, sentences_sql, summaries_sql
from folioflow.plans.ingest import WORD_CHAR, chunks_sql, document_chunks, squeeze_sql, strip_sql
from folioflow.sources.shared import documents, scratch, shared_dir


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Fitted indexes of this process, by application and state of the input files.
_FITTED: dict[tuple, retrieval.SearchIndex] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> retrieval.SearchIndex:
    """The index over all document chunks; fitted at the first search, with its tables in the shared folder, and used by
    later ones until a file of the input changes its name, size or time."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("*")), F.bit_xor(F.hash("*"))).first()
    key = (spark.sparkContext.applicationId, shared_dir(spark), *state)
    if key not in _FITTED:
        _FITTED[key] = retrieval.fit_tfidf(document_chunks(spark, sf_dir), ["document_id", "chunk_index"], keep=True)
    return _FITTED[key]


def search_corpus(spark: SparkSession, sf_dir: str, top_k: int = 5) -> DataFrame:
    """The benchmark texts as queries against all document chunks."""
    return retrieval.search_chunks(corpus_index(spark, sf_dir), _asked(spark, sf_dir), "query_id", "query", top_k)


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index with blocks of postings, filled in two batches: first the short documents, then the
    long ones."""
    index = StoredIndex(spark, f"{shared_dir(spark)}/search-index-{uuid.uuid4().hex}")
    for some in ("n_chars <= 3000", "n_chars > 3000"):
        index.append(document_chunks(spark, sf_dir, where=some))
    return index.search(_asked(spark, sf_dir), "query_id", "query")


def _with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the texts of their chunks, as a table, since what follows reads them more than once: only the documents of
    hits are cut into chunks again."""
    hits = scratch(search_corpus(spark, sf_dir), "hits")
    chunks = document_chunks(spark, sf_dir, hits.select("document_id").distinct())
    texts = hits.join(chunks, ["document_id", "chunk_index"]).join(_asked(spark, sf_dir).withColumnRenamed("query", "question"), "query_id")
    return scratch(texts, "hit-texts")


def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.shape_hits(_with_text(spark, sf_dir)).select(
        "query_id", "rank", "document_id", "chunk_index", "section_name", "page_start", "page_end", "score", "text_preview"
    )


def search_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with short previews and whole texts."""
    out = retrieval.shape_hits(_with_text(spark, sf_dir), limit=40, full_text=True)
    return out.select("query_id", "rank", "text_preview", F.md5("full_text").alias("text_md5"))


def qa_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.source_snippets(_with_text(spark, sf_dir), "query_id")


def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _asked(spark, sf_dir).withColumnRenamed("query", "question")
    return qa.answer_questions(questions, _with_text(spark, sf_dir), "query_id").drop("question")


def _document_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is asked the benchmark text whose number its id leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("document_id"), F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("project_id")
    )
    items = _asked(spark, sf_dir)
    asked = docs.join(F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))).withColumn("query_id", F.col("document_id") % F.col("n"))
    questions = asked.join(items, "query_id").select(F.col("document_id").alias("question_id"), "document_id", F.col("query").alias("question"))
    return docs, questions


def search_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question within its own document."""
    _, questions = _document_questions(spark, sf_dir)
    index = retrieval.fit_tfidf(document_chunks(spark, sf_dir), ["document_id", "chunk_index"], ["document_id"])
    return retrieval.search_chunks(index, questions, "question_id", "question")


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, questions = _document_questions(spark, sf_dir)
    return qa.answer_document_questions(docs, document_chunks(spark, sf_dir), questions)[2]


def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    return qa.summarize_texts(docs, "document_id")


def provider_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as supplied context for its first turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn is not null")
    raw = turns.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("position"), "text")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    questions = first.select(F.col("conv_id").alias("question_id"), F.coalesce("question", F.lit("")).alias("question"))
    context = qa.context_chunks(raw).join(questions, "question_id")
    out = qa.answer_questions(questions, context, "question_id", max_answer_sentences=3, max_source_snippets=1 << 30)
    return out.drop("question")


def rejected_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a search per document, some of them blank, out of range or of unknown documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), "source")
    k = F.col("document_id") % 7
    batch = docs.select(
        F.col("document_id").alias("search_id"), F.when(k == 1, " ").otherwise(F.col("source")).alias("query"), (F.col("document_id") % 13).cast("int").alias("top_k"),
        F.when(k == 2, -F.col("document_id")).when(k == 3, F.col("document_id") + 1_000_000_000).when(k != 4, F.col("document_id")).alias("document_id"),
    )
    return retrieval.search_problems(batch, docs).select("search_id", "problem")


QUERIES = (
    rejected_searches, search_full_text, search_corpus, search_indexed, search_preview, search_document, qa_snippets, qa_answers, chat_log, provider_summary, provider_answer,
)


def terms_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
    words = f"list_filter(regexp_extract_all(lower({x}), '{WORD_CHAR}{{2,}}'), lambda w: w NOT IN ({stop}))"
    return f"(SELECT list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM (SELECT {words} AS ws))"


def search_sql(scope: bool, k: int = 5) -> str:
    """From chunks and queries(qid, document_id, query) to hits."""
    s, own = ("document_id, ", "document_id") if scope else ("", "")
    on = "USING (document_id, term)" if scope else "USING (term)"
    n = "JOIN (SELECT document_id, count(*) AS n FROM chunks WHERE trim(text) <> '' GROUP BY 1) USING (document_id)" if scope else "CROSS JOIN (SELECT count(*) AS n FROM chunks WHERE trim(text) <> '')"
    return f"""ct AS (SELECT document_id, chunk_index, unnest({terms_sql("text")}) AS term FROM chunks),
ctf AS (SELECT document_id, chunk_index, term, 1 + ln(count(*)) AS tf FROM ct GROUP BY ALL),
dfs AS (SELECT {s}term, count(*) AS df FROM ctf GROUP BY ALL),
idf AS (SELECT {s}term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM dfs {n}),
cw AS (SELECT c.document_id, c.chunk_index, c.term, tf * idf AS w FROM ctf c JOIN idf {on}),
clen AS (SELECT document_id, chunk_index, sqrt(sum(w * w)) AS l FROM cw GROUP BY ALL),
qt AS (SELECT qid, {s}unnest({terms_sql("query")}) AS term FROM asked),
qtf AS (SELECT qid, {s}term, 1 + ln(count(*)) AS tf FROM qt GROUP BY ALL),
qw AS (SELECT q.*, tf * idf AS w FROM qtf q JOIN idf {on}),
qlen AS (SELECT qid, sqrt(sum(w * w)) AS l FROM qw GROUP BY ALL),
scores AS (SELECT q.qid, c.document_id, c.chunk_index, round(sum((c.w / cl.l) * (q.w / ql.l)), 9) AS s FROM qw q JOIN qlen ql ON ql.qid = q.qid
  JOIN cw c ON c.term = q.term {"AND c.document_id = q.document_id" if scope else ""} JOIN clen cl ON cl.document_id = c.document_id AND cl.chunk_index = c.chunk_index GROUP BY ALL),
hits AS (SELECT qid, document_id, chunk_index, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, document_id, chunk_index) AS INTEGER) AS rank, round(s, 6) AS score FROM scores WHERE s > 0 QUALIFY rank <= {k})"""


_WHOLE = "whole AS (SELECT doc_id AS document_id, CAST(greatest(1, ceil(n_chars / 3000.0)) AS INTEGER) AS page_count, 0 AS section_pos, ' ' AS section_name, text FROM documents)"
_CORPUS = f"WITH {_WHOLE}, {chunks_sql('whole')}, asked AS (SELECT item_id AS qid, text AS query FROM benchmark), {search_sql(False)}"
_OWN = f"""WITH {_WHOLE}, {chunks_sql('whole')}, asked AS (SELECT doc_id AS qid, doc_id AS document_id, source, b.text AS query FROM documents d JOIN benchmark b
  ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), {search_sql(True)}"""


def _question_terms_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in qa.STOP_WORDS)
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all({ascii_sql(x)}, '\b[a-zA-Z][a-zA-Z''-]{{2,}}\b'), lambda t: lower(t)), lambda t: t NOT IN ({stop})))"


def _clean_sql(x: str) -> str:
    plain = squeeze_sql(x)
    rest = rf"regexp_extract({plain}, '^\s*\p{{Nd}}+(?:\.\p{{Nd}}+)+\s+.+?\b((?:{'|'.join(qa.OPENERS)})\s+[a-z].*)$', 1)"
    return f"CASE WHEN len({_question_terms_sql(rest)}) >= 4 THEN {strip_sql(rest)} ELSE {plain} END"


def answers_sql(most: int) -> str:
    """From retrieved(qid, rank, text, query) to sents, and answers with up to `most` sentences."""
    cleaned = f"list_transform(list_filter({sentences_sql('text')}, lambda s: {strip_sql('s')} <> ''), lambda s: {_clean_sql('s')})"
    return rf"""cut AS (SELECT qid, rank, {_question_terms_sql("query")} AS qts, {cleaned} AS ss FROM retrieved),
flat AS (SELECT qid, rank, qts, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM cut),
sents AS (SELECT *, len(ts) >= 4 AND regexp_matches({strip_sql("sentence")}, '[.!?]$') AS substantive, len(list_intersect(ts, qts)) AS overlap
  FROM (SELECT *, {_question_terms_sql("sentence")} AS ts FROM flat)),
once AS (SELECT * FROM sents WHERE substantive AND overlap > 0 QUALIFY row_number() OVER (PARTITION BY qid, lower(sentence) ORDER BY overlap DESC, rank, pos) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS n FROM once QUALIFY n <= {most}),
answers AS (SELECT qid, string_agg(sentence, ' ' ORDER BY n) AS answer FROM best GROUP BY qid)"""


_TEXTS = "retrieved AS (SELECT h.*, c.text, a.query FROM hits h JOIN chunks c ON c.document_id = h.document_id AND c.chunk_index = h.chunk_index JOIN asked a ON a.qid = h.qid)"
_NONE = qa.NOT_FOUND.replace("'", "''")
SQL: dict[str, str] = {
    "search_corpus": f"{_CORPUS} SELECT qid AS query_id, document_id, chunk_index, rank, score FROM hits",
    "search_indexed": f"{_CORPUS} SELECT qid AS query_id, document_id, chunk_index, rank, score FROM hits",
    "search_preview": f"""{_CORPUS}, p AS (SELECT h.*, section_name, page_start, page_end, {squeeze_sql("text")} AS t FROM hits h JOIN chunks USING (document_id, chunk_index))
SELECT qid AS query_id, rank, document_id, chunk_index, section_name, page_start, page_end, score, CASE WHEN length(t) > 300 THEN regexp_replace(t[:297], '\\s+$', '') || '...' ELSE t END AS text_preview FROM p""",
    "search_document": f"{_OWN} SELECT qid AS question_id, document_id, chunk_index, rank, score FROM hits",
    "qa_snippets": f"""{_CORPUS}, {_TEXTS}, {answers_sql(2)}, top AS (SELECT * FROM sents QUALIFY row_number() OVER (PARTITION BY qid, rank ORDER BY substantive DESC, overlap DESC, length(sentence), pos) = 1)
SELECT r.qid AS query_id, r.rank, coalesce(sentence, {squeeze_sql("text")}) AS snippet FROM retrieved r LEFT JOIN top t ON t.qid = r.qid AND t.rank = r.rank""",
    "qa_answers": f"""{_CORPUS}, {_TEXTS}, {answers_sql(2)} SELECT item_id AS query_id, coalesce(answer, '{_NONE}') AS answer, answer IS NOT NULL AS answer_found
FROM benchmark LEFT JOIN answers ON qid = item_id""",
    "chat_log": f"""{_OWN}, {_TEXTS}, {answers_sql(2)} SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS project_id, a.document_id, {strip_sql("query")} AS question,
  coalesce(answer, '{_NONE}') AS answer, 'local' AS provider_mode, a.qid AS question_id FROM asked a LEFT JOIN answers x USING (qid)""",
    "provider_answer": f"""WITH firsts AS (SELECT conv_id AS qid, coalesce(arg_min(text, turn), '') AS query FROM conversations WHERE turn IS NOT NULL GROUP BY 1),
retrieved AS (SELECT qid, turn AS rank, coalesce(text, '') AS text, query FROM conversations JOIN firsts ON qid = conv_id WHERE turn IS NOT NULL), {answers_sql(3)}
SELECT f.qid AS question_id, coalesce(answer, '{_NONE}') AS answer, answer IS NOT NULL AS answer_found FROM firsts f LEFT JOIN answers USING (qid)""",
    "provider_summary": f"""WITH texts AS (SELECT doc_id AS document_id, 0 AS section_pos, 'abstract' AS section_type, 1.0::DOUBLE AS confidence, {strip_sql("coalesce(text, '')")} AS text FROM documents), {summaries_sql("texts", 150)}
SELECT document_id, summary, selected_sentence_count FROM summed""",
    "rejected_searches": """WITH batch AS (SELECT doc_id AS search_id, CASE WHEN doc_id % 7 = 1 THEN ' ' ELSE source END AS query, doc_id % 13 AS top_k,
  CASE doc_id % 7 WHEN 2 THEN -doc_id WHEN 3 THEN doc_id + 1000000000 WHEN 4 THEN NULL ELSE doc_id END AS document_id FROM documents)
SELECT search_id, CASE WHEN trim(coalesce(query, '')) = '' THEN 'search query must not be empty' WHEN top_k NOT BETWEEN 1 AND 10 THEN 'top_k must be between 1 and 10'
  WHEN document_id <= 0 THEN 'document id must be positive' WHEN document_id NOT IN (SELECT doc_id FROM documents) THEN 'document does not exist' END AS problem FROM batch""",
    "search_full_text": f"""{_CORPUS}, p AS (SELECT h.*, text, {squeeze_sql("text")} AS t FROM hits h JOIN chunks USING (document_id, chunk_index))
SELECT qid AS query_id, rank, CASE WHEN length(t) > 40 THEN regexp_replace(t[:37], '\\s+$', '') || '...' ELSE t END AS text_preview, md5(text) AS text_md5 FROM p""",
}
