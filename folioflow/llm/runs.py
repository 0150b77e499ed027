"""Periodic runs of words, found on an enhanced suffix array by the branching-tandem test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import WORD, table
from folioflow.llm.words import Words, blocks, mix

#: Suffixes of smaller children that are tested at once.
TESTED = 1 << 20


def prefix_ranks(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... numbers, until all differ. Equal ranks at level k are equal
    prefixes of 2**k; a rank is the number of smaller ones, so only suffixes that share theirs are sorted again."""
    order = np.argsort(x, kind="stable")
    fresh = np.r_[True, x[order][1:] != x[order][:-1]]
    rank = np.empty(len(x), np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(x)), 0))
    levels, step, last = [rank], 1, np.r_[fresh[1:], True]
    active = order[~(fresh & last)]
    while len(active):
        rank = levels[-1].copy()
        after = np.where(active + step < len(x), levels[-1][np.minimum(active + step, len(x) - 1)], -1)
        key = rank[active].astype(np.int64) * (len(x) + 1) + after + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        group = np.r_[True, old[1:] != old[:-1]]
        at = np.arange(len(active))
        inside = at - np.maximum.accumulate(np.where(group, at, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[active] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - (at - inside)
        active = active[~(fresh & np.r_[fresh[1:], True])]
        levels.append(rank)
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of pairs of different suffixes."""
    n, size = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + size, b + size
        whole = (p < n) & (q < n)
        size += (whole & (levels[k][np.minimum(p, n - 1)] == levels[k][np.minimum(q, n - 1)])).astype(np.int64) << k
    return size


def common_endings(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the numbers before a and before b agree, a < b."""
    size = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p = a - size - (1 << k)
        at = np.maximum(p, 0)
        size += ((p >= 0) & (levels[k][at] == levels[k][at + b - a])).astype(np.int64) << k
    return size


def _before(values: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place with a value over 0 the nearest earlier one with a smaller value (or an equal one), by jumps over
    places that were passed already. No jump goes over a 0, so others aren't asked for."""
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero(values > 0)
    while len(todo):
        to = at[todo]
        ahead = to >= 0
        ahead[ahead] = (values[to[ahead]] > values[todo[ahead]]) if or_equal else (values[to[ahead]] >= values[todo[ahead]])
        todo = todo[ahead]
        at[todo] = at[to[ahead]]
    return at


def branching_squares(x: np.ndarray, levels: list[np.ndarray], longest: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, d) of all places where x[i:i+d] == x[i+d:i+2d] and what follows ends the repetition, d up to longest[i].

    Each LCP interval of depth d holds the suffixes with one prefix of d numbers, its children those that agree further.
    If i and i + d are in two children of it, one of these isn't the largest: so the suffixes of all smaller children
    look where i + d and i - d are in the suffix array. A run of `exponent` periods puts as many suffixes in its interval.
    """
    n, isa = len(x), levels[-1].astype(np.int64)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    pairs = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[pairs] = common_prefixes(levels, sa[pairs - 1], sa[pairs])
    left, near = np.maximum(_before(lcp, False), 0), np.maximum(_before(lcp, True), 0)
    right = len(lcp) - 1 - _before(lcp[::-1], False)[::-1]
    edges = np.flatnonzero(lcp > 0)
    edges = edges[(right[edges] - left[edges] >= exponent) & (lcp[edges] <= longest[sa[edges]])]
    if not len(edges):
        return edges, edges
    # children: from the edge before to each edge, and from the last edge of an interval to its end
    names, interval = np.unique(left[edges] * (n + 1) + right[edges], return_inverse=True)
    final = np.zeros(len(names), np.int64)
    final[interval] = edges  # the last one stays
    low, high = np.r_[near[edges], final], np.r_[edges, right[final]]
    owner, depth = np.r_[interval, np.arange(len(names))], np.r_[lcp[edges], lcp[final]]
    a, b = np.r_[left[edges], left[final]], np.r_[right[edges], right[final]]
    order = np.lexsort((high - low, owner))
    small = np.ones(len(order), bool)
    small[order[np.r_[np.flatnonzero(np.diff(owner[order])), len(order) - 1]]] = False  # the largest of each
    low, high, depth, a, b = (v[small] for v in (low, high, depth, a, b))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    batch = np.cumsum(high - low) // TESTED
    for part in np.split(np.arange(len(low)), np.flatnonzero(np.diff(batch)) + 1):
        size = (high - low)[part]
        child = np.repeat(part, size)
        at = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + low[child]
        i, d = sa[at], depth[child]
        for other in (i + d, i - d):
            inside = (other >= 0) & (other < n)
            to = isa[np.clip(other, 0, n - 1)]
            hit = inside & (to >= a[child]) & (to < b[child]) & ((to < low[child]) | (to >= high[child]))
            out.append((np.minimum(i, other)[hit], d[hit]))
    i, d = (np.concatenate(v) for v in zip(*out, strict=True))
    return i, d


def word_runs(x: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period. Row r has the numbers x[first[r]:first[r+1]]; rows share
    no number."""
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none, none
    levels = prefix_ranks(x)
    n = np.diff(first)
    i, d = branching_squares(x, levels, np.repeat(n // exponent, n), exponent)
    # rotated to the left as far as the period goes, each square gives its run
    start, end = i - common_endings(levels, i, i + d), i + 2 * d
    long = end - start >= np.maximum(least, exponent * d)
    start, end, d = start[long], end[long], d[long]
    order = np.lexsort((d, end, start))
    start, end, d = start[order], end[order], d[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # multiples of a period come after it
    start, end, d = start[fresh], end[fresh], d[fresh]
    order = np.lexsort((d, start))
    return start[order], end[order], d[order]


def _runs(batches: Iterator[pa.RecordBatch], exponent: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "_text"):
        words = Words(batch.column("_text"))
        _, x = np.unique(words.hashes() ^ mix(words.row.astype(np.uint64), 5), return_inverse=True)
        start, end, period = word_runs(x, words.first, exponent, least)
        row = words.row[start]
        gone = np.zeros(len(x) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, end, -1)
        kept, raw, texts = np.cumsum(gone)[:-1] == 0, words.bytes.tobytes(), []
        for r, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if kept[a:b].all():
                texts.append(b" ".join(raw[words.bounds[r] : words.bounds[r + 1]].split()))
            else:
                keep = np.flatnonzero(kept[a:b]) + a
                texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep], words.ends[keep], strict=True)]))
        fields = [pa.array(v, pa.int64()) for v in (start - words.first[row], end - start, period)]
        found = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        keep = [c for c in batch.schema.names if c != "_text"]
        columns = [pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), found), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], [*keep, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of words of each whole text, and the text without their repetitions.

    A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least `least` words
    and `exponent` periods long, that no neighbouring word extends. A block of texts is one sequence of numbers, in which
    texts share none; its suffix array comes from prefix doubling, and the ranks of all lengths 2**k give LCP values and
    the rotation of squares to the left. Squares that end a run, one for each multiple of its period, become runs; the
    smallest period of a stretch stays. Work is n log n, memory some 4 bytes a word for each doubling that the longest
    repeat needs, for a block of 2 MB or one longer text.

    Returns the id column, n_words long, runs (array of start, length and period, by start and then period; empty for
    none) and collapsed: the words outside every run and the first period of each, joined by one space, so the first
    period of a run is lost only where another run repeats it. Null texts have no words and collapse to an empty text.
    Rows are judged one by one, whatever ids repeat; other columns aren't read. Words are compared by 64-bit hashes.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", kind), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(lambda it: _runs(it, exponent, least), schema)


def longest_run(runs: Column) -> Column:
    """The longest run, of equal ones the first, of those the one with the smallest period; null for none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by a checksum of their ids, go on from some word with a repetition of what follows it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("ws"))
    sized = cut.withColumn("n", F.size("ws")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    planned = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    words = F.concat(F.slice("ws", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return planned.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with repetitions planted in a tenth, and their runs."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    best = found.withColumn("best", longest_run(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
