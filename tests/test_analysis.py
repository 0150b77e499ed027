"""Keywords, statistics, summaries, research information."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import keywords, research, statistics, summaries
from folioflow.plans import analysis

SECTION = "d int, section_pos int, section_type string, section_name string, text string, confidence double"


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Solar panel, solar cell; the panel -cell- and solar"), (2, "the and of"), (3, None)], "d int, text string")
    rows = keywords.extract_keywords(df, "d", top_n=2).orderBy("rank").collect()
    assert [(r.keyword, r.frequency) for r in rows] == [("solar", 3), ("cell", 2)]
    assert rows[0].score == pytest.approx(round(3 / 7 * (1 + math.log(3)), 6))
    with pytest.raises(ValueError):
        keywords.extract_keywords(df, "d", top_n=0)


def test_readability_and_references(spark):
    df = spark.createDataFrame([("The cake is made. It cost 3.50 and we ate it.",), ("",), (None,)], "t string")
    rows = statistics.readability(df, "t").collect()
    assert (rows[0].sentence_count, rows[0].average_words_per_sentence) == (2, 5.0)
    assert rows[1].flesch_reading_ease is None and rows[2].sentence_count == 0
    count = lambda t: spark.range(1).select(statistics.reference_count(F.lit(t)).alias("n")).first().n
    assert count("[1] One.\n2. Two\nStone, A. Title\nKing et al. found") == 4
    assert count("as shown (Stone, 2019) and (King, 1999)") == 2


def test_syllables(spark):
    words = {"cake": 1, "the": 1, "readability": 5, "'": 0, "bcd": 1}
    for w, n in words.items():
        assert spark.range(1).select(statistics.syllables(F.lit(w)).alias("n")).first().n == n, w


def test_summaries(spark):
    rows = [
        (1, 0, "abstract", "Abstract", "Solar panels make power. Power from solar panels is clean power. Birds sing.", 0.95),
        (1, 1, "references", "References", "Not this. Never this one.", 0.95),
        (1, 2, "results", "Results", ", broken start here. Figure 1 shows a thing.", 0.5),
        (1, 3, "abstract", "Abstract", "Only one sentence about power.", 0.95),
    ]
    df = spark.createDataFrame(rows, SECTION)
    got = {r.section_pos: r for r in summaries.summarize_sections(df, "d", max_words=12).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0].source_sentence_indexes == [0, 1] and got[2].summary == "" and got[3].selected_sentence_count == 1
    best = summaries.best_summaries(summaries.summarize_sections(df, "d"), "d").collect()
    assert [(r.section_type, r.section_pos, r.position) for r in best] == [("abstract", 0, 1)]
    limits = summaries.summarize_sections(df, "d").where("section_pos = 2").select(summaries.summary_limitations().alias("l")).first().l
    assert limits == [summaries.ALWAYS, summaries.UNSURE, summaries.NOTHING]


def test_heading_before_a_sentence_goes(spark):
    text = "2.1 Study Area The area of the study lies in the north"
    assert spark.range(1).select(summaries.clean_sentence(F.lit(text)).alias("s")).first().s == "The area of the study lies in the north"


def test_research(spark):
    rows = [
        (1, 0, "introduction", "Introduction", "The problem is a lack of data.\nRQ1: Which plan is best?\nThe problem is a lack of data.", 0.95),
        (1, 1, "methodology", "Methodology", "Nothing special was done.", 0.95),
        (2, 0, "unknown", "Unknown", "  ", 0.0),
        (3, 0, "unknown", "Unknown", "Birds sing.", 0.0),
    ]
    df = spark.createDataFrame(rows, SECTION)
    items = research.extract_research_information(df, "d")
    got = {(r.field, r.rank): r for r in items.collect()}
    assert got["research_problem", 1].matched_keywords == ["problem", "lack"]
    assert got["research_problem", 1].confidence == 0.8 and ("research_problem", 2) not in got
    assert got["research_questions", 1].extracted_text == "Which plan is best?"
    assert got["methodology", 1].extracted_text == "Nothing special was done." and got["methodology", 1].confidence == 0.6
    docs = spark.createDataFrame([(1,), (2,), (3,)], "d int")
    assert research.primary_fields(docs, items, "d").count() == 27
    warnings = {r.d: r.warnings for r in research.research_warnings(docs, df, items, "d").collect()}
    assert warnings == {1: [], 2: [research.NO_TEXT], 3: [research.NO_PATTERN]}


def test_sections_that_are_read_twice_are_made_once(spark):
    for query in (analysis.research_warnings, analysis.document_statistics):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "documents.parquet" not in plan and "Study " not in plan  # the title that papers get


def test_tokens_are_counted_in_batches(spark):
    rng = random.Random(4)
    word = lambda: f"t{rng.randrange(6)}"
    rows = [(i, [[word() for _ in range(rng.randrange(5))] for _ in range(rng.randrange(4))], [word() for _ in range(rng.randrange(9))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, own array<array<string>>, tokens array<string>").repartition(3)
    got = {r.i: r.s for r in df.select("i", summaries.token_sums("own", "tokens").alias("s")).collect()}
    assert got == {i: [sum(tokens.count(t) for t in s) for s in own] for i, own, tokens in rows}
    text = "Figure x is Figure 3.1 here. Figures xy show 2.1 Alpha and 2.2 Beta of these. Doing organs of men shows more. See doi of men here."
    rows = spark.createDataFrame([(text, "abstract")], "text string, section_type string")
    assert summaries.summarize_sections(rows, max_sentences=9).first().source_sentence_indexes == [2]
    plan = summaries.summarize_sections(rows)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan
