"""Extractive answers from retrieved chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.operators import retrieval
from folioflow.operators.summaries import summarize_sections, trim_heading

# Words that are no question terms, openers after a heading, and texts.
STOP_WORDS = (
    "about", "after", "also", "and", "are", "can", "did", "does", "for", "from", "has", "have", "how", "into", "is", "of", "on",
    "or", "paper", "study", "that", "the", "this", "use", "used", "using", "was", "were", "what", "when", "where", "which",
    "who", "why", "with",
)
OPENERS = ("In", "The", "This", "These", "Those", "A", "An", "Although", "However")
NOT_FOUND = (
    "I could not find the answer in the retrieved source chunks. "
    "Review the source snippets below or try a more specific question."
)


def question_terms(c: Column) -> Column:
    return T.question_terms(c, STOP_WORDS)


def clean_sentence(sentence: Column) -> Column:
    return trim_heading(T.squeeze(sentence), OPENERS, lambda rest: F.size(question_terms(rest)) >= 4)


def split_sentences(c: Column) -> Column:
    return F.transform(F.filter(T.raw_sentences(c), lambda s: T.strip(s) != ""), clean_sentence)


def _sentences(retrieved: DataFrame, query_key: str, text_col: str, question_col: str) -> DataFrame:
    """(query, rank, pos, sentence, substantive, overlap) for the sentences of each retrieved chunk."""
    rows = retrieved.withColumn("_terms", question_terms(F.col(question_col)))
    rows = T.exploded(rows, split_sentences(F.col(text_col)), "pos", "sentence", query_key, "rank", "_terms")
    rows = rows.withColumn("_own", question_terms(F.col("sentence")))
    return rows.select(
        query_key, "rank", "pos", "sentence",
        ((F.size("_own") >= 4) & T.strip(F.col("sentence")).rlike(r"[.!?]$")).alias("substantive"),
        F.size(F.array_intersect("_own", "_terms")).alias("overlap"),
    )


def source_snippets(retrieved: DataFrame, query_key: str, text_col: str = "text", question_col: str = "question", max_source_snippets: int = 5) -> DataFrame:
    """(query, rank, snippet): of each chunk the sentence with the largest overlap, then the shortest, then the first;
    among substantive ones if there are any; the whole text where there is no sentence."""
    if max_source_snippets < 1:
        raise ValueError("snippet limit must be positive")
    rows = retrieved.where((F.col("rank") <= max_source_snippets) & (T.strip(T.text_or_empty(F.col(text_col))) != ""))
    best = Window.partitionBy(query_key, "rank").orderBy(F.desc("substantive"), F.desc("overlap"), F.length("sentence"), "pos")
    picked = _sentences(rows, query_key, text_col, question_col).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    out = rows.select(query_key, "rank", T.squeeze(F.col(text_col)).alias("_whole")).join(picked.select(query_key, "rank", "sentence"), [query_key, "rank"], "left")
    return out.select(query_key, "rank", F.coalesce("sentence", "_whole").alias("snippet"))


def answer_questions(
    questions: DataFrame, retrieved: DataFrame, query_key: str, text_col: str = "text", question_col: str = "question",
    max_answer_sentences: int = 2, max_source_snippets: int = 5,
) -> DataFrame:
    """(query, question, answer, answer_found): the substantive sentences with the largest overlap, in the order of
    overlap, chunk and place, each text once; a fixed text where nothing is found."""
    if max_answer_sentences < 1 or max_source_snippets < 1:
        raise ValueError("answer limits must be positive")
    rows = retrieved.where(F.col("rank") <= max_source_snippets)
    found = _sentences(rows, query_key, text_col, question_col).where("substantive and overlap > 0").repartition(query_key)  # once, for all below
    place = [F.desc("overlap"), "rank", "pos"]
    once = Window.partitionBy(query_key, F.lower("sentence")).orderBy(*place)
    found = found.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy(query_key).orderBy(*place))).where(F.col("_n") <= max_answer_sentences)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sentence"))), lambda x: x["sentence"]), " ")
    answers = found.groupBy(query_key).agg(joined.alias("answer"))
    out = questions.select(query_key, T.strip(F.col(question_col)).alias("question")).join(answers, query_key, "left")
    return out.select(query_key, "question", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.col("answer").isNotNull().alias("answer_found"))


def answer_document_questions(
    documents: DataFrame, chunks: DataFrame, questions: DataFrame, top_k: int = 5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, snippets and chat rows for (question_id, document_id, question).

    Questions that are blank or name no document are left out. Each document is a scope of its own.
    """
    known = questions.where(T.strip(T.text_or_empty(F.col("question"))) != "").join(documents.select("document_id", "project_id"), "document_id")
    own = chunks.join(known.select("document_id").distinct(), "document_id", "left_semi")
    retrieval.check_top_k(top_k)
    index = retrieval.fit_tfidf(own, ["document_id", "chunk_index"], ["document_id"], carry=["text"])
    retrieved = retrieval.search_scopes(index, known, "question_id", "question", top_k)
    answers = answer_questions(known, retrieved, "question_id", max_source_snippets=top_k)
    snippets = source_snippets(retrieved, "question_id", max_source_snippets=top_k)
    chat = answers.join(known.select("question_id", "document_id", "project_id"), "question_id").select(
        "project_id", "document_id", "question", "answer", F.lit("local").alias("provider_mode"), "question_id"
    )
    return answers, snippets, chat


def summarize_texts(df: DataFrame, key: str, text_col: str = "text", max_words: int = 150) -> DataFrame:
    """(key, summary, selected_sentence_count) of free texts, taken as abstracts; blank texts get an empty one."""
    rows = df.select(key, T.strip(T.text_or_empty(F.col(text_col))).alias("text"), F.lit(0).alias("section_pos"), F.lit("abstract").alias("section_type"))
    return summarize_sections(rows, key, max_words=max_words).select(key, "summary", "selected_sentence_count")


def context_chunks(raw: DataFrame) -> DataFrame:
    """Supplied context chunks with defaults: (chunk_id or id or position + 1, document_id or 0, chunk_index or position,
    score or 0, text or full_text or snippet or empty). `position` counts from 0; zeros and empty texts count as absent."""
    have = set(raw.columns)
    pick = lambda kind, none, *names: F.coalesce(*[F.nullif(F.col(n).cast(kind), F.lit(none).cast(kind)) for n in names if n in have], F.lit(None).cast(kind))
    position = F.col("position").cast("long")
    return raw.select(
        *[c for c in ("question_id", "section_name", "page_start", "page_end") if c in have],
        F.coalesce(pick("long", 0, "chunk_id", "id"), position + 1).alias("chunk_id"),
        F.coalesce(pick("long", 0, "document_id"), F.lit(0)).alias("document_id"),
        F.coalesce(pick("long", 0, "chunk_index"), position).alias("chunk_index"),
        F.coalesce(pick("double", 0.0, "score"), F.lit(0.0)).alias("score"),
        F.coalesce(pick("string", "", "text", "full_text", "snippet"), F.lit("")).alias("text"),
        (position + 1).cast("int").alias("rank"),
    )
