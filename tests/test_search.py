"""Search and answers."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import qa, retrieval

CHUNKS = [
    (1, 0, "Solar panels turn light into power. The panels last for twenty years in dry places."),
    (1, 1, "Wind turbines turn moving air into power. They need steady wind to work well."),
    (2, 0, "Bees make honey and live in large groups near flowers."),
    (2, 1, "  "),
]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "document_id long, chunk_index int, text string")


def test_terms_bridge_stop_words(spark):
    got = spark.range(1).select(retrieval.search_terms(F.lit("Power of the wind")).alias("t")).first().t
    assert got == ["power", "wind", "power wind"]


def test_scores_equal_plain_python(spark):
    index = retrieval.fit_tfidf(chunks(spark), ["document_id", "chunk_index"])
    queries = spark.createDataFrame([(1, "solar power panels"), (2, "unknownword"), (3, " ")], "q int, text string")
    got = {(r.document_id, r.chunk_index): r.score for r in retrieval.search_chunks(index, queries, "q", "text").collect()}
    terms = {(d, c): Counter(spark.range(1).select(retrieval.search_terms(F.lit(t)).alias("t")).first().t) for d, c, t in CHUNKS if t.strip()}
    df = Counter(t for c in terms.values() for t in c)
    idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    q = vector(Counter(["solar", "power", "panels", "solar power", "power panels"]))
    want = {k: sum(x * vector(c).get(t, 0) for t, x in q.items()) for k, c in terms.items()}
    assert got == {k: pytest.approx(s, abs=1e-6) for k, s in want.items() if s > 0}


def test_lengths_move_terms_once_and_dealt(spark):
    rows = [(d, i, f"alpha beta{d % 3} beta{d % 3} gamma{i} delta{d}") for d in range(1, 8) for i in range(2)]
    index = retrieval.fit_tfidf(spark.createDataFrame(rows, "document_id long, chunk_index int, text string"), ["document_id", "chunk_index"])
    terms = {(d, c): Counter(spark.range(1).select(retrieval.search_terms(F.lit(t)).alias("t")).first().t) for d, c, t in rows}
    df = Counter(t for c in terms.values() for t in c)
    want = {k: math.sqrt(sum(((1 + math.log(n)) * (math.log(15 / (1 + df[t])) + 1)) ** 2 for t, n in c.items())) for k, c in terms.items()}
    for lengths in (index.lengths, retrieval.chunk_lengths(index.rows, len(rows), ("document_id", "chunk_index"), buckets=1)):
        assert {(r.document_id, r.chunk_index): r.length for r in lengths.collect()} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    plan = index.lengths._jdf.queryExecution().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(term" not in plan  # no term moves as a row


def test_scopes_equal_indexes_of_their_own(spark):
    own = [(1, 1, "solar power power in dry places"), (2, 2, "honey, honey and bees"), (3, 2, "unknownword")]
    queries = spark.createDataFrame(own, "q int, document_id long, text string")
    found = retrieval.search_chunks(retrieval.fit_tfidf(chunks(spark), ["document_id", "chunk_index"], ["document_id"]), queries, "q", "text")
    got = {(r.q, r.chunk_index): (r["rank"], r.score) for r in found.collect()}
    want = {}
    for q, d, _ in own:
        index = retrieval.fit_tfidf(chunks(spark).where(f"document_id = {d}"), ["document_id", "chunk_index"])
        hits = retrieval.search_chunks(index, queries.where(f"q = {q}").drop("document_id"), "q", "text")
        want |= {(q, r.chunk_index): (r["rank"], r.score) for r in hits.collect()}
    assert got == want and len(got) == 3
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(document_id" in plan and "term#" not in plan  # terms of a scope stay in its row


def test_limits(spark):
    for bad in ((None, 5, None), (" ", 5, None), ("x", 0, None), ("x", 11, None), ("x", 5, 0)):
        with pytest.raises(ValueError):
            retrieval.check_search(*bad)
    assert retrieval.check_search(" x ", 10) == "x"
    text = "word " * 100
    cut = spark.range(1).select(retrieval.preview(F.lit(text)).alias("p")).first().p
    assert len(cut) <= 300 and cut.endswith("...")


def test_answers_within_documents(spark):
    docs = spark.createDataFrame([(1, 4), (2, 4)], "document_id long, project_id int")
    questions = spark.createDataFrame(
        [(1, 1, " How long do solar panels last? "), (2, 2, "How long do solar panels last?"), (3, 9, "Anything?"), (4, 1, " ")],
        "question_id int, document_id long, question string",
    )
    answers, snippets, chat = qa.answer_document_questions(docs, chunks(spark), questions)
    got = {r.question_id: r for r in answers.collect()}
    assert set(got) == {1, 2}
    assert got[1].answer_found and "twenty years" in got[1].answer and got[1].question == "How long do solar panels last?"
    assert not got[2].answer_found and got[2].answer == qa.NOT_FOUND
    assert snippets.where("question_id = 1 and rank = 1").first().snippet.startswith("Solar panels turn")  # equal overlap, shorter
    assert {(r.project_id, r.provider_mode) for r in chat.collect()} == {(4, "local")}


def test_supplied_context(spark):
    raw = spark.createDataFrame([(1, 0, None, "Bees make honey for long winters.", None), (1, 1, 5, None, "full")], "question_id int, position int, chunk_id long, text string, full_text string")
    rows = qa.context_chunks(raw).orderBy("rank").collect()
    assert [(r.chunk_id, r.chunk_index, r.text, r.score) for r in rows] == [(1, 0, "Bees make honey for long winters.", 0.0), (5, 1, "full", 0.0)]
    texts = spark.createDataFrame([(1, "Bees make honey. Bees make honey every summer day."), (2, " ")], "d int, text string")
    got = {r.d: r for r in qa.summarize_texts(texts, "d").collect()}
    assert got[1].selected_sentence_count == 2 and got[2].summary == ""
