"""Cleaning, sections and chunks on small texts of their own."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T
from folioflow.operators import chunking, cleaning, sections


def cleaned(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.cleaned_text for r in cleaning.clean_text(df).orderBy("i").collect()]


def test_cleaning_steps(spark):
    got = cleaned(
        spark,
        "a\x00b\x08c", "exam-\n  ple text", "one  two\t three\r\nfour", None, "   ",
        "Running Head\nFirst sentence here.\n1\nRunning Head\nSecond sentence here.\nPage 2 of 3\nRUNNING HEAD\nThird.",
        "the line goes\non and on\nEnds here.\nNew one", "Methods\nwe did it", "1. item\nnext words",
    )
    assert got[:5] == ["abc", "example text", "one two three four", "", ""]
    assert got[5] == "First sentence here.\nSecond sentence here.\nThird."
    assert got[6] == "the line goes on and on\nEnds here.\nNew one"
    assert got[7] == "Methods\nwe did it"
    assert got[8] == "1. item\nnext words"


def test_repeated_sentences_stay_and_bad_settings_fail(spark):
    assert cleaned(spark, "Same words.\nSame words.\nSame words.") == ["Same words.\nSame words.\nSame words."]
    with pytest.raises(ValueError):
        cleaning.remove_repeated_artifacts(spark.createDataFrame([("a",)], "t string"), "t", 1)


def test_statistics_and_warnings(spark):
    df = spark.createDataFrame([("a b\x00",), ("",), ("\x01\x02",), (None,)], "text string")
    rows = cleaning.run_text_cleaning(df).collect()
    assert (rows[0].original_character_count, rows[0].cleaned_character_count, rows[0].original_word_count) == (4, 3, 2)
    assert rows[1].cleaning_warnings == [cleaning.EMPTY_INPUT]
    assert rows[2].cleaning_warnings == [cleaning.EMPTY_RESULT, cleaning.LARGE_REDUCTION]


@pytest.mark.parametrize(
    ("line", "kind"),
    [("Abstract", "abstract"), ("2 Related Work", "literature_review"), ("3) METHODS", "methodology"), ("References (selected)", "references"),
     ("4.1 Yield of Trial", "results"), ("6.2 Outlook", "conclusion"), ("Findings from Town", "results"), ("Some Heading", None), ("We used methods.", None)],
)
def test_headings(spark, line, kind):
    assert spark.range(1).select(sections.classify_heading(F.lit(line)).alias("k")).first().k == kind


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "d int, cleaned_text string")
    return sections.explode_sections(sections.detect_sections(df), "d").orderBy("section_pos").collect()


def test_sections(spark):
    text = "A Small Study\nlost line\nAbstract\nShort text.\nMore.\n\nMethods\nMETHODS\nDone."
    rows = found(spark, text)
    assert [(r.section_type, r.text) for r in rows] == [
        ("title", "A Small Study"), ("abstract", "Short text.\nMore."), ("methodology", ""), ("methodology", "Done."),
    ]
    assert text[rows[1].start_index : rows[1].end_index].startswith("Abstract\nShort")
    assert [r.confidence for r in rows] == [0.75, 0.95, 0.95, 0.95]


def test_sections_without_headings(spark):
    assert [(r.section_type, r.text) for r in found(spark, "Just a title\nand the body is lost")] == [("title", "Just a title")]
    assert [(r.section_type, r.text) for r in found(spark, "A sentence.\nAnother.")] == [("unknown", "A sentence.\nAnother.")]
    assert [(r.section_type, r.text) for r in found(spark, None)] == [("unknown", "")]


def spans(spark, n, size, overlap):
    ranges = spark.range(1).select(chunking.chunk_ranges(F.lit(n), size, overlap).alias("r")).first().r
    return [(r.start, r.end) for r in ranges]


def by_search(n, size, overlap):
    """The rule step by step, and the final pair by trying all of them."""
    if n <= chunking.MAX_SINGLE:
        return [(0, n)] if n else []
    out, start = [], 0
    while not (n - start <= chunking.MAX_PAIR and n - (start + size - overlap) <= chunking.MAX_SINGLE):
        out.append((start, start + size))
        start += size - overlap
    rest = n - start
    pairs = [
        (abs(f - size) + abs(rest - f + o - size) + abs(o - overlap), f, rest - f + o, o)
        for f in range(500, 801) for o in range(100, 151) if 500 <= rest - f + o <= 800
    ]
    _, f, _, o = min(pairs) if pairs else (0, min(size, rest), 0, 0)
    return [*out, (start, start + f), (start + f - o, n)]


@pytest.mark.parametrize("setting", [(700, 125), (500, 150), (800, 100)])
def test_ranges_equal_a_search(spark, setting):
    for n in (0, 1, 849, 850, 1000, 1400, 1501, 3333):
        assert spans(spark, n, *setting) == by_search(n, *setting), n


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(7, text, 5)], "document_id long, text string, page_count int")
    df = df.withColumn("sections", F.array(F.struct(F.lit(" ").alias("section_name"), F.col("text")), F.struct(F.lit("Results").alias("section_name"), F.lit("few words").alias("text"))))
    rows = chunking.split_sections_into_chunks(df).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].section_name == "Unknown" and rows[-1].section_name == "Results"
    assert {w for r in rows[:-1] for w in r.text.split()} == set(text.split())
    assert all(500 <= r.word_count <= 800 for r in rows[:-1])
    assert (rows[0].page_start, rows[-2].page_end, rows[-1].page_start, rows[-1].page_end) == (1, 5, 1, 5)
    for bad in ((499, 125), (801, 125), (700, 99), (700, 151)):
        with pytest.raises(ValueError):
            chunking.check_settings(*bad)


def test_tokens_equal_python(spark):
    texts = ["½ x² d'été can't abc-9 -a- naïve_1 e-mail's', 3.14 x. Y?", "日本 ab äbc bäc z9z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for java, python in ((T.ANALYSIS_WORD, r"\b[a-zA-Z][a-zA-Z'-]*\b"), (T.KEYWORD_TOKEN, r"\b[a-zA-Z][a-zA-Z-]{2,}\b"), (rf"{T.WORD_CHAR}+", r"\b\w+\b")):
        assert [r.x for r in df.select(T.found(F.col("t"), java).alias("x")).collect()] == [re.findall(python, t) for t in texts]
    assert df.select(T.raw_sentences(F.col("t")).alias("x")).first().x[-2:] == ["½ x² d'été can't abc-9 -a- naïve_1 e-mail's', 3.14 x.", " Y?"]


def test_lines_are_counted_as_far_as_they_decide(spark):
    plan = cleaning.clean_text(spark.createDataFrame([("a\nb",)], "text string"))._jdf.queryExecution().toString()
    assert "+, 8)" in plan and ", -1) AS words" not in plan  # words of a line are split off only until there are more than few
    six, seven = "One two three four five six", "One two three four five six seven"
    letters = "x" * (cleaning.HEADING_LETTERS + 40)
    text = f"{six}\nNext line\n\n{seven}\nNext line\n\n{'1 ' * 60}{letters}\nnext"
    got = cleaning.clean_text(spark.createDataFrame([(text,)], "text string")).first().cleaned_text
    assert got == f"{six}\nNext line\n\n{seven} Next line\n\n{'1 ' * 60}{letters} next"
    tabs = "a \t b  c\r\rd \r\n e -\n f x-\n y"
    assert spark.range(1).select(cleaning.normalize_whitespace(cleaning.repair_hyphenated_line_breaks(F.lit(tabs))).alias("t")).first().t == "a b c\n\nd\ne -\nf xy"
