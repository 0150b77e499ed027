"""Cleaning of extracted text: one projection per step, all within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

# Lines that are headings, without numbering.
HEADINGS = (
    "abstract", "summary", "introduction", "background", "literature review", "review of literature", "related work",
    "previous studies", "methodology", "methods", "method", "materials and methods", "research methodology", "results",
    "findings", "discussion", "analysis", "conclusion", "conclusions", "concluding remarks", "references",
    "bibliography", "works cited",
)
# Warnings.
EMPTY_INPUT = "Input text is empty."
EMPTY_RESULT = "Cleaned text is empty after removing extraction noise."
LARGE_REDUCTION = "Cleaning removed more than half of the original characters."

# What page numbers and list items look like.
PAGE_NUMBER = r"(?i)^(?:page\s*)?\p{Nd}+(?:\s*(?:of|/)\s*\p{Nd}+)?$"
LIST_ITEM = r"^(\p{Nd}+[.)]|[A-Za-z][.)]|[-*\x{2022}])\s+"


# The patterns of the three functions below are fixed values, too.


def remove_control_characters(c: Column) -> Column:
    """Tabs and line breaks stay."""
    return F.regexp_replace(T.text_or_empty(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def repair_hyphenated_line_breaks(c: Column) -> Column:
    """Words that a hyphen splits over lines become one again."""
    return F.regexp_replace(T.text_or_empty(c), rf"-(?<={T.WORD_CHAR}-){T.SPACE}*\n{T.SPACE}*(?={T.WORD_CHAR})", "")  # the hyphen first: few places have one


def normalize_whitespace(c: Column) -> Column:
    """One kind of line break, single spaces inside lines, at most one blank line in a row."""
    unified = F.regexp_replace(T.text_or_empty(c), r"\r\n?", "\n")
    single = F.regexp_replace(unified, r" *\t[ \t]*| {2,}", " ")  # a single space needs no change
    trimmed = F.transform(F.split(single, "\n"), T.strip)
    return T.strip(F.regexp_replace(F.array_join(trimmed, "\n"), r"\n{3,}", "\n\n"))


def _lines_and_repeats(df: DataFrame, col: str, min_repetitions: int) -> DataFrame:
    """Add `_parts`, the lines, and `_repeated`, the lower-case lines that occur `min_repetitions` times or more."""
    df = df.withColumn("_parts", F.split(T.text_or_empty(F.col(col)), "\n"))
    df = df.withColumn("_keys", F.sort_array(F.transform("_parts", lambda l: F.lower(T.strip(l)))))
    later = F.slice("_keys", min_repetitions, F.greatest(F.size("_keys"), F.lit(1)))
    same = F.zip_with("_keys", later, lambda a, b: F.when((a == b) & (a != ""), a))
    return df.withColumn("_repeated", F.array_distinct(F.filter(same, lambda k: k.isNotNull()))).drop("_keys")


def remove_repeated_artifacts(df: DataFrame, col: str, min_repetitions: int = 3) -> DataFrame:
    """Drop page numbers, and short lines without a final mark that occur `min_repetitions` times or more.

    Lines compare case-insensitively. The sorted lines show what repeats, as a line equals the one `min_repetitions`
    - 1 places on; no pair of lines is formed.
    """
    if min_repetitions < 2:
        raise ValueError("min_repetitions must be at least 2")

    def stays(line: Column) -> Column:
        l = T.strip(line)
        short = (F.length(l) <= 120) & ~l.rlike(r"[.?!]\z") & (F.size(T.space_words(l)) <= 10)
        return (l == "") | ~(l.rlike(PAGE_NUMBER) | (F.array_contains("_repeated", F.lower(l)) & short))

    df = _lines_and_repeats(df, col, min_repetitions)
    # `_repeated` stands outside the lambda too: a column with one use is moved into the lambda and made for each line
    plain = F.filter("_parts", lambda l: ~T.strip(l).rlike(PAGE_NUMBER))
    kept = F.when(F.size("_repeated") > 0, F.filter("_parts", stays)).otherwise(plain)
    return df.withColumn(col, T.strip(F.array_join(kept, "\n"))).drop("_parts", "_repeated")


# Fixed values, too: how a line is brought to the form of HEADINGS.
def is_heading_line(line: Column) -> Column:
    unnumbered = F.regexp_replace(F.lower(T.strip(line)), r"^\p{Nd}+(?:\.\p{Nd}+)*[.)]?\s+", "")
    return T.squeeze(F.regexp_replace(unnumbered, "[^a-z0-9 &/-]+", "")).isin(*HEADINGS)


#: No heading has more letters.
HEADING_LETTERS = max(sum(c.isalpha() for c in h) for h in HEADINGS)
#: A line of no more words ends where the next begins with a capital letter.
FEW_WORDS = 6


def fix_broken_lines(df: DataFrame, col: str) -> DataFrame:
    """Join lines of a paragraph that belong together, from left to right; blank paragraphs go.

    A line stands alone after a line with a final mark, and if it is a heading or a list item. Only what lies between
    such breaks is folded: there the words and letters so far decide, and the joined line itself only while it is
    short enough for a heading. The fold gathers where lines begin, so no text grows in it. Letters and words are counted
    only as far as they decide.
    """
    own = F.transform(
        F.split(T.text_or_empty(F.col(col)), "\n\n"),
        lambda p: F.filter(F.transform(F.split(p, "\n"), lambda l: T.strip(l)), lambda l: l != ""),
    )
    df = df.withColumn("_own", F.filter(own, lambda p: F.size(p) > 0))
    letters = lambda l: F.length(F.regexp_replace(F.lower(l), "[^a-z]+", ""))
    first = lambda l: F.struct(l.alias("l"), letters(F.substring(l, 1, 2 * HEADING_LETTERS)).alias("n"))
    enough = lambda x: (x["n"] > HEADING_LETTERS) | (F.length(x["l"]) <= 2 * HEADING_LETTERS)
    counts = lambda x: F.struct(x["l"].alias("l"), F.when(enough(x), x["n"]).otherwise(letters(x["l"])).alias("letters"))
    flags = lambda x: F.struct(
        x["l"].alias("l"), ((x["letters"] <= HEADING_LETTERS) & is_heading_line(x["l"])).alias("h"), x["l"].rlike(LIST_ITEM).alias("i"),
        F.substring(x["l"], 1, 1).rlike(r"^\p{Lu}").alias("u"), F.right(x["l"], F.lit(1)).isin(".", "!", "?", ":", ";").alias("e"),
        x["letters"].alias("letters"), F.size(F.split(x["l"], rf"{T.SPACE}+", FEW_WORDS + 2)).alias("words"),
    )
    df = df.withColumn("_known", F.transform("_own", lambda p: F.transform(F.transform(F.transform(p, first), counts), flags)))

    def line(begins: Column, now: Column, item: Column, letters: Column, words: Column, k: Column) -> Column:
        return F.struct(begins.alias("begins"), now.alias("now"), item.alias("item"), letters.alias("letters"), words.alias("words"), k.alias("k"))

    def step(acc: Column, x: Column) -> Column:
        k = acc["k"] + 1
        alone = x["b"] | acc["item"] | (x["u"] & (acc["words"] <= FEW_WORDS)) | ((acc["letters"] <= HEADING_LETTERS) & is_heading_line(acc["now"]))
        letters = acc["letters"] + x["letters"]
        now = F.when(letters <= HEADING_LETTERS, F.concat_ws(" ", acc["now"], x["l"])).otherwise("")
        joined = line(acc["begins"], now, acc["item"], letters, acc["words"] + x["words"], k)
        return F.when(alone, line(F.array_append(acc["begins"], k), x["l"], x["i"], x["letters"], x["words"], k)).otherwise(joined)

    def begins(p: Column) -> Column:
        """Which lines of a paragraph begin a new one."""
        breaks = F.transform(p, lambda x, i: F.struct(
            x["l"].alias("l"), x["i"].alias("i"), x["u"].alias("u"), x["letters"].alias("letters"), x["words"].alias("words"),
            (x["h"] | x["i"] | ((i > 0) & F.get(p, i - 1)["e"])).alias("b"),
        ))
        none = line(F.array().cast("array<int>"), F.lit(""), F.lit(True), F.lit(0), F.lit(0), F.lit(-1))
        return F.aggregate(breaks, none, step, lambda a: a["begins"])

    df = df.withColumn("_begins", F.transform("_known", begins))
    cut = F.zip_with("_own", "_begins", lambda p, b: F.struct(p.alias("p"), b.alias("b")))
    lines = F.transform(cut, lambda c: F.array_join(F.transform(
        c["b"], lambda i, k: F.array_join(F.slice(c["p"], i + 1, F.coalesce(F.get(c["b"], k + 1), F.size(c["p"])) - i), " ")
    ), "\n"))
    return df.withColumn(col, T.strip(F.array_join(lines, "\n\n"))).drop("_own", "_known", "_begins")


def clean_text(df: DataFrame, text_col: str = "text", out_col: str = "cleaned_text", min_repetitions: int = 3) -> DataFrame:
    """Add the cleaned text; a null text is an empty one. Steps are projections of their own, so that none is
    evaluated twice."""
    out = df.withColumn(out_col, remove_control_characters(F.col(text_col)))
    out = out.withColumn(out_col, repair_hyphenated_line_breaks(F.col(out_col)))
    out = out.withColumn(out_col, normalize_whitespace(F.col(out_col)))
    out = fix_broken_lines(remove_repeated_artifacts(out, out_col, min_repetitions), out_col)
    return out.withColumn(out_col, normalize_whitespace(F.col(out_col)))


def cleaning_statistics(original: Column, cleaned: Column) -> dict[str, Column]:
    o, c = T.text_or_empty(original), T.text_or_empty(cleaned)
    return {
        "original_character_count": F.length(o),
        "cleaned_character_count": F.length(c),
        "removed_character_count": F.greatest(F.length(o) - F.length(c), F.lit(0)),
        "original_word_count": T.word_count(o),
        "cleaned_word_count": T.word_count(c),
        "original_line_count": T.line_count(o),
        "cleaned_line_count": T.line_count(c),
    }


def cleaning_warnings(original: Column, cleaned: Column) -> Column:
    o, c = T.text_or_empty(original), T.text_or_empty(cleaned)
    blank = T.strip(o) == ""
    removed = F.greatest(F.length(o) - F.length(c), F.lit(0))
    found = F.array(
        F.when(blank, EMPTY_INPUT),
        F.when(~blank & (T.strip(c) == ""), EMPTY_RESULT),
        F.when((F.length(o) > 0) & (2 * removed > F.length(o)), LARGE_REDUCTION),
    )
    return F.filter(found, lambda w: w.isNotNull())


def run_text_cleaning(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Cleaned text, counts and warnings of every row."""
    out = clean_text(df, text_col)
    o, c = F.col(text_col), F.col("cleaned_text")
    return out.withColumns(cleaning_statistics(o, c) | {"cleaning_warnings": cleaning_warnings(o, c)})
