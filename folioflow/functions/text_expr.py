"""Tokens, lines and sentences as Column expressions.

Java's `\\w` and `\\b` see ASCII only, so word boundaries are written out over letters, digits and underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x{85}\p{Z}\x1c-\x1f]"
#: The characters of SPACE, for functions that take a set.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
OTHER_SPACE = r"[\t\n\x0b\f\r\x{85}\x1c-\x1f\p{Z}&&[^ ]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STARTS = rf"(?<!{WORD_CHAR})"
#: The same behind a word's first letter, so that most places fail at the letter, before anything is looked at behind.
STARTED = rf"(?<!{WORD_CHAR}[a-zA-Z])"
ENDS = rf"(?:(?<={WORD_CHAR})(?!{WORD_CHAR})|(?<!{WORD_CHAR})(?={WORD_CHAR}))"

# What counts as a word, a keyword, a term of a question and a sentence.
ANALYSIS_WORD = rf"[a-zA-Z]{STARTED}[a-zA-Z'-]*{ENDS}"
KEYWORD_TOKEN = rf"[a-zA-Z]{STARTED}[a-zA-Z-]{{2,}}{ENDS}"
QUESTION_TOKEN = rf"[a-zA-Z]{STARTED}[a-zA-Z'-]{{2,}}{ENDS}"
SENTENCE = r"[^.!?]+[.!?]?"
DECIMAL_DOT = "<DOT>"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def found(c: Column, pattern: str) -> Column:
    """All matches, in order; null counts as empty."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and Unicode spaces included."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White-space runs as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, rf" *{OTHER_SPACE}{SPACE}*| {{2,}}", " "))  # a single space needs no change


def word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(rf"{WORD_CHAR}+")).cast("int")


def analysis_word_count(c: Column) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(ANALYSIS_WORD)).cast("int")


def space_words(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text_or_empty(c), rf"{SPACE}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end starts no line, an empty text has none."""
    parts = F.split(text_or_empty(c), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(c: Column) -> Column:
    return F.size(lines(c))


def question_terms(c: Column, stop_words: tuple[str, ...]) -> Column:
    """The distinct lower-case terms of a question or sentence that aren't stop words."""
    return F.array_except(
        F.transform(found(c, QUESTION_TOKEN), lambda t: F.lower(t)), F.array(*map(F.lit, stop_words))
    )


def raw_sentences(c: Column) -> Column:
    """Runs up to a full stop, question or exclamation mark; a dot between two digits ends nothing."""
    kept = F.regexp_replace(text_or_empty(c), r"\.(?<=\p{Nd}\.)(?=\p{Nd})", DECIMAL_DOT)
    return F.transform(F.regexp_extract_all(kept, F.lit(SENTENCE), F.lit(0)), lambda s: F.replace(s, F.lit(DECIMAL_DOT), F.lit(".")))


def exploded(df: DataFrame, array: Column | str, pos: str, value: str, *keep: Column | str) -> DataFrame:
    """One row per element, with its position. The outer form makes the optimiser infer no filter on the array, which
    it would push below, to where the array would have to be made again."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def half_even(hundredths_numerator: Column, denominator: Column) -> Column:
    """A quotient of integers rounded to 2 digits; ties, which are exact here, go to the even digit."""
    n, d = hundredths_numerator * 100, denominator
    low = F.floor(n / d)
    twice = 2 * (n - low * d)
    up = F.when((twice > d) | ((twice == d) & (low % 2 == 1)), 1).otherwise(0)
    return (low + up) / F.lit(100.0)
