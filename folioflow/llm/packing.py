"""Optimal length buckets: dynamic programming over the length histogram, then token-budget batches."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, positions, saved, table


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding; `lengths` ascending and distinct.

    best[j] is the least number of slots with the first j lengths; the last bucket holds the lengths i..j-1 and pads
    all of them to lengths[j-1], which costs best[i] + lengths[j-1] * (below[j] - below[i]). For each i that is a line
    in lengths[j-1], ever flatter as i grows, so the lower hull of the lines gives all minima of a round in one pass:
    buckets * n steps, in exact integers.
    """
    n = len(lengths)
    if not n:
        return []
    at, below = [int(x) for x in lengths], [0, *accumulate(int(c) for c in counts)]
    best: list[int | None] = [0] + [None] * n
    came = []
    for _ in range(min(buckets, n)):
        hull, first, nxt, back = [], 0, [0], [0]
        for j in range(1, n + 1):
            c, x = j - 1, at[j - 1]
            if best[c] is not None:
                while len(hull) - first > 1:
                    a, b = hull[-2], hull[-1]
                    if (best[c] - best[a]) * (below[b] - below[a]) > (best[b] - best[a]) * (below[c] - below[a]):
                        break
                    hull.pop()
                hull.append(c)
            while len(hull) - first > 1 and best[hull[first + 1]] - best[hull[first]] < x * (below[hull[first + 1]] - below[hull[first]]):
                first += 1
            i = hull[first]
            nxt.append(best[i] + x * (below[j] - below[i]))
            back.append(i)
        came.append(back)
        best = nxt
    bounds, j = [], n
    for back in reversed(came):
        if j:
            bounds.append(at[j - 1])
            j = back[j]
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length_col: str,
    id_col: str = "doc_id",
    buckets: int = 8,
    batch_tokens: int = 32768,
) -> DataFrame:
    """Give every row a bucket (padded length) and a batch of at most `batch_tokens` padded tokens.

    The histogram has one bin per distinct length, and the bounds are the best of all. The driver sees the histogram:
    n distinct lengths need n * n / 2 tokens at least, so 100,000 bins don't occur below 5,000,000,000 tokens. No row
    is cut: the last bound is the longest length. A row longer than the budget is a batch of its own. Rows of length 0
    or null (counted as 0) form bucket 0 with length 0 and a single batch of their own kind, numbered like the others.

    Returns id, n_tokens, bucket, bucket_length, batch, slot, padding. Ties in length go by id; repeated rows each
    get a slot; an empty table gives no rows; other columns are not read.
    """
    if buckets < 1 or batch_tokens < 1:
        raise ValueError("buckets and batch_tokens must be positive")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")
    )
    rows = saved(rows, "lengths")
    bins = rows.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    bounds = bucket_bounds(bins["n_tokens"].to_numpy(), bins["count"].to_numpy(), buckets)
    bucket, length, low = F.lit(0), F.lit(0), 0
    for k, bound in enumerate(bounds, 1):
        here = (F.col("n_tokens") > low) & (F.col("n_tokens") <= bound)
        bucket, length, low = F.when(here, k).otherwise(bucket), F.when(here, bound).otherwise(length), bound
    rows = rows.select(
        "doc_id", "n_tokens", bucket.cast("int").alias("bucket"), length.cast("long").alias("bucket_length")
    )
    placed = positions(rows, ["bucket", "n_tokens", "doc_id"], group=["bucket"])
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(F.lit(1), F.col("bucket_length"))))
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(F.col("pos") / room).cast("long").alias("batch"),
        (F.col("pos") % room).cast("long").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def word_count(col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by their number of words."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", word_count().alias("n_tokens")), "n_tokens")
