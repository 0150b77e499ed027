"""Overlapping word chunks per section, with estimated pages."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

SIZES, OVERLAPS = (500, 800), (100, 150)
MAX_SINGLE = 2 * SIZES[0] - OVERLAPS[1] - 1
MAX_PAIR = 2 * SIZES[1] - OVERLAPS[0]


def check_settings(size: int, overlap: int) -> None:
    if not SIZES[0] <= size <= SIZES[1]:
        raise ValueError("chunk size must be between 500 and 800 words")
    if not OVERLAPS[0] <= overlap <= OVERLAPS[1]:
        raise ValueError("chunk overlap must be between 100 and 150 words")


@cache
def final_pairs(size: int, overlap: int) -> tuple[tuple[int, int], ...]:
    """For each number of remaining words up to MAX_PAIR: size of the last chunk but one, and start of the last one.

    Of all allowed pairs the one nearest to the settings, then with the smaller first and second chunk and overlap;
    where none is allowed, the chunks meet without overlap.
    """
    pairs = []
    for rest in range(MAX_PAIR + 1):
        # with the overlap fixed, sizes add up to rest + overlap; the distance is least where both are near `size`
        best = None
        for o in range(OVERLAPS[0], OVERLAPS[1] + 1):
            both = rest + o
            low, high = max(SIZES[0], both - SIZES[1]), min(SIZES[1], both - SIZES[0])
            for first in sorted({min(max(x, low), high) for x in (low, size, both - size)}) if low <= high else ():
                second = both - first
                rank = (abs(first - size) + abs(second - size) + abs(o - overlap), first, second, o)
                best = rank if best is None or rank < best else best
        pairs.append((best[1], best[1] - best[3]) if best else (min(size, rest), min(size, rest)))
    return tuple(pairs)


def chunk_ranges(n: Column, size: int = 700, overlap: int = 125) -> Column:
    """(start, end) word ranges of a text of n words: one chunk if it is short, else windows of `size` that overlap,
    and at the end a pair that shares what is left."""
    check_settings(size, overlap)
    step = size - overlap
    windows = F.greatest(F.lit(0), F.ceil((n - min(MAX_PAIR, MAX_SINGLE + step)) / step)).cast("int")
    rest = n - windows * step
    low = min(MAX_PAIR, MAX_SINGLE + step) - step  # `rest` is larger
    ends, begins = (F.element_at(F.expr(f"array({','.join(map(str, x))})"), rest - low + 1) for x in zip(*final_pairs(size, overlap)[low:], strict=True))

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))

    plain = F.when(windows > 0, F.transform(F.sequence(F.lit(0), windows - 1), lambda k: span(k * step, k * step + size)))
    plain = F.coalesce(plain, F.array().cast("array<struct<start:int,end:int>>"))
    base = windows * step
    return (
        F.when(n <= 0, F.array().cast("array<struct<start:int,end:int>>"))
        .when(n <= MAX_SINGLE, F.array(span(F.lit(0), n)))
        .otherwise(F.concat(plain, F.array(span(base, base + ends), span(base + begins, n))))
    )


def page_range(start: Column, end: Column, total: Column, pages: Column) -> tuple[Column, Column]:
    """Pages that a word range covers if words spread evenly; null without pages."""
    known = pages.isNotNull() & (pages > 0) & (total > 0)
    first = F.least(F.greatest(F.floor((start / total) * pages) + 1, F.lit(1)), pages)
    last = F.least(F.greatest(F.ceil((end / total) * pages), first), pages)
    return F.when(known, first).cast("int"), F.when(known, last).cast("int")


def split_sections_into_chunks(
    df: DataFrame, key: str = "document_id", pages_col: str = "page_count", size: int = 700, overlap: int = 125
) -> DataFrame:
    """One row per chunk of documents with a `sections` array: key, chunk_index, section_name, page_start, page_end,
    text, word_count. Narrow: the index comes from the order within the row."""
    with_words = df.withColumn(
        "_parts",
        F.transform("sections", lambda s: F.struct(T.strip(s["section_name"]).alias("name"), T.space_words(s["text"]).alias("words"))),
    )
    ranges = F.flatten(
        F.transform(
            "_parts",
            lambda p, k: F.transform(
                chunk_ranges(F.size(p["words"]), size, overlap), lambda r: F.struct(k.alias("part"), r["start"].alias("start"), r["end"].alias("end"))
            ),
        )
    )
    rows = T.exploded(with_words, ranges, "chunk_index", "_r", key, F.col(pages_col).alias("_pages"), "_parts")
    part = F.get(F.col("_parts"), F.col("_r.part"))
    start, end, total = F.col("_r.start"), F.col("_r.end"), F.size(part["words"])
    first, last = page_range(start, end, total, F.col("_pages"))
    return rows.select(
        key, "chunk_index", F.when(part["name"] == "", "Unknown").otherwise(part["name"]).alias("section_name"),
        first.alias("page_start"), last.alias("page_end"),
        F.array_join(F.slice(part["words"], start + 1, end - start), " ").alias("text"), (end - start).alias("word_count"),
    )
