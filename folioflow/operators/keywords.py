"""Keywords of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text_expr as T

# Words that are no keywords.
STOP_WORDS = tuple(
    """able about above across after again against all almost also and another any are around based but although among
    can because been before being below between both for how into may not off one our out own per set she the too two
    use used uses using via cannot could did does doing during each from further his had has have having here hers
    herself himself its itself just more most nor now onto only other ought ours ourselves over same shall should some
    such than that their theirs them themselves then there these they this those through thus under until very was were
    what when where which while who whom why will with would your yours yourself yourselves abstract chapter figure
    paper section table""".split()
)


def keyword_tokens(c: Column, min_word_length: int = 3) -> Column:
    """Lower-case tokens without outer hyphens, short ones and stop words, in order."""
    if min_word_length < 1:
        raise ValueError("minimum word length must be positive")
    tokens = F.transform(T.found(F.lower(c), T.KEYWORD_TOKEN), lambda t: F.btrim(t, F.lit("-")))
    return F.filter(tokens, lambda t: (F.length(t) >= min_word_length) & ~t.isin(*STOP_WORDS))


def extract_keywords(df: DataFrame, key: str, text_col: str = "text", top_n: int = 10, min_word_length: int = 3) -> DataFrame:
    """(key, rank, keyword, score, frequency) of the top_n keywords; ranks go by the rounded score, frequency, word.

    Counting is one aggregation over (key, keyword) with partial sums; the window works on the counts.
    """
    if top_n < 1:
        raise ValueError("keyword limit must be positive")
    tokens = T.exploded(df, keyword_tokens(F.col(text_col), min_word_length), "_pos", "keyword", key)
    counts = tokens.groupBy(key, "keyword").agg(F.count(F.lit(1)).cast("int").alias("frequency"))
    share = F.col("frequency") / F.sum("frequency").over(Window.partitionBy(key))
    scored = counts.withColumn("score", F.round(share * (1 + F.log("frequency")), 6))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("frequency"), "keyword")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).select(key, "rank", "keyword", "score", "frequency")
