"""Extractive summaries of sections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from folioflow.functions import text_expr as T
from folioflow.operators.keywords import keyword_tokens

# Sections that are summarised, openers after a heading, and texts of limitations.
SECTION_TYPES = ("abstract", "introduction", "literature_review", "methodology", "results", "discussion", "conclusion")
OPENERS = ("According", "Although", "Based", "However", "In", "The", "Thermal", "This", "These", "Those", "To", "Trans", "A", "An")
ALWAYS = "Extractive summary uses original sentences only and does not rewrite or infer missing context."
UNSURE = "Section confidence is heuristic because section detection is rule-based."
NOTHING = "No extractable summary sentences were found for this section."
SHORT = "Short section produced fewer than two summary sentences."
# What no summary sentence has.
PLACEHOLDERS = ("need to modify", "modify it later", "distribution of", "presented in figure")
CAPTIONS = ("figure ", "table ", "appendix ", "number of ")
BULLETS = ("\uf0b7", "\u2022")
NUMBERED = r"\p{Nd}+(?:\.\p{Nd}+)+"


def heading_prefix(openers: tuple[str, ...]) -> str:
    return rf"^\s*{NUMBERED}\s+.+?{T.ENDS}(?<!{T.WORD_CHAR})((?:{'|'.join(openers)})\s+[a-z].*)$"


def trim_heading(sentence: Column, openers: tuple[str, ...], enough) -> Column:
    """A sentence without the numbered heading before it, if what is left is long enough."""
    rest = T.strip(F.regexp_extract(sentence, heading_prefix(openers), 1))
    numbered = sentence.rlike(r"^\s*\p{Nd}")  # few sentences are, and only those are searched further
    return F.when(numbered & (rest != "") & enough(rest), rest).otherwise(sentence)


def _plain(sentence: Column) -> Column:
    bare = F.when(sentence.contains("http"), F.regexp_replace(sentence, r"https?://[^\s\x{85}\p{Z}\x1c-\x1f]+", "")).otherwise(sentence)
    return T.squeeze(bare)


def _trimmed(plain: Column) -> Column:
    return trim_heading(plain, OPENERS, lambda rest: T.analysis_word_count(rest) >= 6)


def clean_sentence(sentence: Column) -> Column:
    return _trimmed(_plain(sentence))


def split_sentences(c: Column) -> Column:
    """Cleaned sentences that have a word. In steps, as a lambda makes what it names twice twice."""
    plain = F.transform(F.filter(T.raw_sentences(c), lambda s: s.rlike(T.ANALYSIS_WORD)), _plain)
    return F.transform(plain, _trimmed)


def is_candidate(sentence: Column, low: Column, words: Column) -> Column:
    """Whether a cleaned sentence, which has no space at its ends, can stand in a summary; `low` is it in lower case. What
    is searched with a pattern has a text that the pattern needs."""
    s = sentence
    bad = s.rlike(r"\A[,;:)\]]") | (low.contains("figure") & low.rlike(rf"{T.STARTS}figure\s+x(?!{T.WORD_CHAR})"))
    for text in PLACEHOLDERS:
        bad = bad | low.contains(text)
    for text in CAPTIONS:
        bad = bad | low.startswith(text)
    named = low.contains("doi") | low.contains("org") | low.contains("http") | low.contains("www.")
    bad = bad | (named & s.rlike(rf"(?i){T.STARTS}(?:doi(?!{T.WORD_CHAR})|org(?!{T.WORD_CHAR})|https?://(?={T.WORD_CHAR})|www\.(?={T.WORD_CHAR}))"))
    dotted = F.instr(s, ".").between(1, F.length(s) - 1)  # a number with a dot has something behind it
    bad = bad | (dotted & (F.regexp_count(s, F.lit(rf"{T.STARTS}{NUMBERED}\s+[A-Z]")) >= 2))
    for mark in BULLETS:
        bad = bad | (s.contains(mark) & (F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit(""))) >= 2))
    bad = bad | (dotted & s.rlike(rf"^\s*{NUMBERED}\s+\S+(?:\s+\S+){{0,5}}\s*$"))
    return (words >= 3) & ~bad


@F.arrow_udf(ArrayType(LongType()))
def token_sums(own: pa.Array, all_tokens: pa.Array) -> pa.Array:
    """For each sentence's tokens (own: arrays of arrays) how often they occur among all tokens of their row, summed. A batch
    of rows is counted at once: tokens get codes, a row and a code are one number."""
    lengths = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sentences = own.flatten()
    per_row, per_sentence, per_all = lengths(own), lengths(sentences), lengths(all_tokens)
    parts = [x.cast(pa.large_string()) for x in (all_tokens.flatten(), sentences.flatten())]
    codes = pa.chunked_array(parts, pa.large_string()).combine_chunks().dictionary_encode()
    width = max(len(codes.dictionary), 1)
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(len(own)), per_all), np.repeat(np.repeat(np.arange(len(own)), per_row), per_sentence)])
    keyed = row * width + code
    known, counts = np.unique(keyed[: per_all.sum()], return_counts=True)
    asked = keyed[per_all.sum() :]
    if len(known):
        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        found = np.where(known[place] == asked, counts[place], 0)
    else:
        found = np.zeros(len(asked), np.int64)
    upto = np.concatenate([[0], np.cumsum(found)])
    ends = np.cumsum(per_sentence)
    sums = upto[ends] - upto[ends - per_sentence]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.array(sums, pa.int64()))


def summarize_sections(
    sections: DataFrame, *keys: str, text_col: str = "text", max_sentences: int = 2, max_words: int = 90
) -> DataFrame:
    """Per section of a summarised type: summary, selected_sentence_count, source_sentence_indexes.

    A sentence scores the mean frequency of its keywords in the section, and a bonus for being early. In order of
    score, sentences are taken while they fit in `max_words`; of those the first `max_sentences` stay, in text order.
    Everything happens within the section's row: nothing is shuffled. Tokens are counted with numpy, for all rows of an
    Arrow batch together.
    """
    if max_sentences < 1 or max_words < 1:
        raise ValueError("summary limits must be positive")
    rows = sections.where(F.col("section_type").isin(*SECTION_TYPES)).withColumn("_sentences", split_sentences(F.col(text_col)))
    rows = rows.withColumn("_own", F.transform("_sentences", lambda s: keyword_tokens(s))).withColumn("_sums", token_sums("_own", keyword_tokens(F.col(text_col))))
    rows = rows.withColumn("_sizes", F.transform("_own", lambda ts: F.size(ts))).drop("_own")
    scored = F.transform(F.arrays_zip("_sentences", "_sums", "_sizes"), lambda x, i: F.struct(
        x["_sentences"].alias("sentence"), F.when(x["_sizes"] > 0, F.round(x["_sums"] / x["_sizes"] + 0.1 / (i + 1), 6)).otherwise(0.0).alias("score")
    ))
    each = F.transform(scored, lambda x, i: F.struct((-x["score"]).alias("low"), i.cast("int").alias("index"), T.analysis_word_count(x["sentence"]).alias("words"), x["sentence"].alias("sentence"), F.lower(x["sentence"]).alias("lower")))
    ranked = F.filter(each, lambda x: is_candidate(x["sentence"], x["lower"], x["words"]))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<index:int,sentence:string>>").alias("picks"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["words"] <= max_words
        pick = F.struct(x["index"].alias("index"), x["sentence"].alias("sentence"))
        return F.when(fits, F.struct((acc["used"] + x["words"]).alias("used"), F.array_append(acc["picks"], pick).alias("picks"))).otherwise(acc)

    picks = F.aggregate(F.array_sort(ranked), start, take, lambda a: F.array_sort(F.slice(a["picks"], 1, max_sentences)))
    out = rows.withColumn("_picks", picks).drop(text_col, "_sentences", "_sums", "_sizes")
    return (
        out.withColumn("summary", T.strip(F.array_join(F.transform("_picks", lambda p: p["sentence"]), " ")))
        .withColumn("selected_sentence_count", F.size("_picks"))
        .withColumn("source_sentence_indexes", F.transform("_picks", lambda p: p["index"]))
        .drop("_picks")
    )


def summary_confidence() -> Column:
    """0.75 of the section's confidence and a quarter for two sentences; 0 without a summary."""
    part = F.least(F.col("selected_sentence_count"), F.lit(2))
    value = F.round(F.col("confidence") * 75 + part * 12.5, 6)
    return F.when(F.col("summary") == "", 0.0).otherwise(F.bround(value, 0) / 100)


def summary_limitations() -> Column:
    found = F.array(
        F.lit(ALWAYS),
        F.when(F.col("confidence") < 0.8, UNSURE),
        F.when(F.col("summary") == "", NOTHING).when(F.col("selected_sentence_count") < 2, SHORT),
    )
    return F.filter(found, lambda x: x.isNotNull())


def best_summaries(summaries: DataFrame, *keys: str) -> DataFrame:
    """The best non-empty summary per section type: most sentences, then confidence, then words, then first. `position`
    numbers the types by where their first non-empty summary stands."""
    # empty ones go after the windows: a filter before them would be pushed below all steps of the summary, with all of them in it
    own = summaries.withColumns({"confidence": summary_confidence(), "_some": F.col("summary") != ""})
    by_type = Window.partitionBy(*keys, "section_type")
    rank = by_type.orderBy(F.desc("_some"), F.desc("selected_sentence_count"), F.desc("confidence"), F.desc(T.word_count(F.col("summary"))), "section_pos")
    best = own.withColumns({"_rank": F.row_number().over(rank), "_first": F.min(F.when(F.col("_some"), F.col("section_pos"))).over(by_type)}).where("_rank = 1 and _some")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    return best.withColumn("position", place).drop("_rank", "_first", "_some")
