"""Word counts, references and readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

# What a line of a reference list, and a citation in running text, look like.
REFERENCE_ENTRY = rf"(?i)^\s*(?:\[\p{{Nd}}+\]|\p{{Nd}}+[.)]|{T.WORD_CHAR}[\p{{L}}\p{{N}}_'-]+,\s+(?:[A-Z]\.\s*)+|{T.WORD_CHAR}[\p{{L}}\p{{N}}_'-]+\s+et\s+al\.)"
CITATION = r"\([A-Z][A-Za-z'-]+,\s*(?:19|20)\p{Nd}{2}\)"


def words_by_section(sections: DataFrame, key: str = "document_id") -> DataFrame:
    name = F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit("Unknown"))
    return sections.groupBy(key, name.alias("section_name")).agg(F.sum(T.analysis_word_count(F.col("text"))).alias("word_count"))


def chunks_by_section(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    name = F.coalesce(F.nullif(T.strip(F.col("section_name")), F.lit("")), F.lit("Unknown"))
    return chunks.groupBy(key, name.alias("section_name")).agg(F.count(F.lit(1)).alias("chunk_count"))


def reference_text(sections: Column, text: Column) -> Column:
    """Text of the reference sections of an array of sections, or else the whole text."""
    own = F.filter(sections, lambda s: (s["section_type"] == "references") | F.lower(T.strip(s["section_name"])).isin("references", "bibliography"))
    joined = F.array_join(F.transform(own, lambda s: T.text_or_empty(s["text"])), "\n")
    return F.coalesce(F.nullif(joined, F.lit("")), T.text_or_empty(text))


def reference_count(text: Column) -> Column:
    """Lines that look like entries; if there are none, citations in the text."""
    entries = F.size(F.filter(T.lines(text), lambda l: T.strip(l).rlike(REFERENCE_ENTRY)))
    return F.when(entries > 0, entries).otherwise(F.regexp_count(text, F.lit(CITATION))).cast("int")


def syllables(word: Column) -> Column:
    """Groups of vowels, less a final e; at least 1 if there is a letter."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = F.when(letters.endswith("e") & (groups > 1), 1).otherwise(0)
    return F.when(letters == "", 0).otherwise(F.greatest(groups - silent, F.lit(1)))


def readability(df: DataFrame, text_col: str) -> DataFrame:
    """Add sentence_count, average_words_per_sentence, average_syllables_per_word, flesch_reading_ease.

    Averages are rounded to 2 digits with integer arithmetic, the score is computed from the rounded ones.
    """
    df = df.withColumn("_words", T.found(F.col(text_col), T.ANALYSIS_WORD))
    df = df.withColumn("_n", F.size("_words")).withColumn("_syllables", F.aggregate("_words", F.lit(0), lambda a, w: a + syllables(w)))
    sentences = F.filter(T.raw_sentences(F.col(text_col)), lambda s: s.rlike(T.ANALYSIS_WORD))
    df = df.withColumn("sentence_count", F.size(sentences).cast("int"))
    some = (F.col("_n") > 0) & (F.col("sentence_count") > 0)
    average = lambda a, b: F.when(some, T.half_even(F.col(a), F.col(b))).otherwise(0.0)
    df = df.withColumn("average_words_per_sentence", average("_n", "sentence_count"))
    df = df.withColumn("average_syllables_per_word", average("_syllables", "_n"))
    # in units of 1e-5, so that rounding has no binary noise
    words, beats = (F.round(F.col(c) * 100).cast("long") for c in ("average_words_per_sentence", "average_syllables_per_word"))
    exact = F.lit(20683500).cast("long") - 1015 * words - 84600 * beats
    flesch = F.when(some, F.round(exact / 1000).cast("long") / F.lit(100.0))
    return df.withColumn("flesch_reading_ease", flesch).drop("_words", "_n", "_syllables")


def document_statistics(df: DataFrame, chunks: DataFrame, key: str = "document_id", text_col: str = "cleaned_text") -> DataFrame:
    """Statistics per document with a `sections` array: total words, maps of words and chunks by section, references,
    readability. One join with the chunk counts, by key."""
    each = F.transform("sections", lambda s: F.struct(
        F.coalesce(F.nullif(T.strip(s["section_name"]), F.lit("")), F.lit("Unknown")).alias("name"), T.analysis_word_count(s["text"]).alias("n")
    ))
    df = df.withColumn("_each", each)
    names = F.array_distinct(F.transform("_each", lambda e: e["name"]))
    totals = F.transform(names, lambda n: F.aggregate(F.filter("_each", lambda e: e["name"] == n), F.lit(0), lambda a, e: a + e["n"]))
    out = readability(df.withColumn("word_count_by_section", F.map_from_arrays(names, totals)).drop("_each"), text_col)
    out = out.withColumn("total_word_count", T.analysis_word_count(F.col(text_col)))
    out = out.withColumn("reference_count_estimate", reference_count(reference_text(F.col("sections"), F.col(text_col))))
    counts = chunks_by_section(chunks, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section_name", "chunk_count"))).alias("chunk_count_by_section"))
    columns = (
        "total_word_count", "word_count_by_section", "chunk_count_by_section", "reference_count_estimate", "sentence_count",
        "average_words_per_sentence", "average_syllables_per_word", "flesch_reading_ease",
    )
    none = F.create_map().cast("map<string,bigint>")
    return out.join(counts, key, "left").withColumn("chunk_count_by_section", F.coalesce("chunk_count_by_section", none)).select(key, *columns)
