"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import positions, saved, table
from folioflow.llm.packing import word_count

#: Stands for a null source inside a job; sorts after every other key because the keys of real sources begin with "0".
NULL_KEY = "1"
#: Steps after which a source that is still off its target is an error; each step halves a bracket at least.
STEPS, TOLERANCE = 200, 1e-6


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets by source key: the weights, repeating in the order of the keys, share `share` times all sizes; a
    source gets at most `most` times its own size and the excess is shared again among the others by weight."""
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    state = saved(
        positions(totals, ["key"])
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full", F.col("weight") <= 0),
        "weights",
    )
    whole = share * (state.agg(F.sum("source_size")).first()[0] or 0)
    while True:  # each round fills at least one more source, or is the last
        free, used = state.agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))), F.sum(F.when(F.col("full") & (F.col("weight") > 0), F.col("cap")))
        ).first()
        level = max(0.0, whole - (used or 0.0)) / free if free else 0.0
        goal = F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level)
        over = ~F.col("full") & (goal > F.col("cap"))
        if not free or not state.where(over).limit(1).count():
            return state.select("key", "source_size", goal.alias("target"))
        state = saved(state.withColumn("full", F.col("full") | over), "weights")


def balanced_rates(hist: DataFrame, targets: DataFrame, base: float, most: int) -> DataFrame:
    """Add the expected number of copies, `rate`, to each (key, size, docs).

    Among all rates between 0 and `most` that meet a source's token target, these have the least relative entropy to
    `base` copies of every document (binomial with `most` trials). They are that binomial, tilted by
    exp(theta * size): rate = most / (1 + exp(-(logit(base / most) + theta * size / scale))). Each source's theta
    solves the convex dual, whose gradient is sum(docs * size * rate) - target. The sums of a Newton step are one
    distributed aggregation for all sources; a bracket halves where a step would leave it.
    """
    scale = hist.groupBy("key").agg(
        (F.sum(F.col("size") * F.col("docs")) / F.greatest(F.sum("docs"), F.lit(1))).alias("scale")
    )
    spread = F.greatest(F.col("scale"), F.lit(1.0))
    odds = F.log(F.lit(base / (most - base)))
    part = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("target") / F.greatest(F.lit(1e-9), most * F.col("source_size"))))
    state = saved(
        targets.join(scale, "key").select(
            "key", "source_size", "target", spread.alias("scale"), (F.log(part / (1 - part)) - odds).alias("theta"),
            F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
            ((F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))).alias("done"),
        ),
        "dual",
    )

    def rate() -> F.Column:
        tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds + F.col("theta") * F.col("size") / F.col("scale")))
        return most / (1 + F.exp(-tilt))

    for step_number in itertools.count():
        if not state.where("not done").limit(1).count():
            break
        if step_number == STEPS:
            raise ValueError(f"a source is off its target after {STEPS} steps")
        at = hist.join(state.where("not done"), "key").withColumn("r", rate())
        x = F.col("size") / F.col("scale")
        sums = at.groupBy("key").agg(
            F.sum(F.col("docs") * F.col("size") * F.col("r")).alias("got"),
            F.sum(F.col("docs") * F.col("size") * x * F.col("r") * (1 - F.col("r") / most)).alias("slope"),
        )
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("theta")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("theta"))
        step = F.col("theta") + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.when(F.col("slope") > 0, gap / F.col("slope")).otherwise(F.signum(gap) * 4)))
        inside = (step > F.col("low_")) & (step < F.col("high_"))
        half = F.when(F.col("low_") == float("-inf"), F.col("high_") - 4).when(F.col("high_") == float("inf"), F.col("low_") + 4).otherwise((F.col("low_") + F.col("high_")) / 2)
        near = F.abs(gap) <= TOLERANCE * F.col("target")
        state = saved(
            state.join(sums, "key", "left")
            .withColumns({"low_": low, "high_": high})
            .select(
                "key", "source_size", "target", "scale",
                F.when(F.col("done") | near, F.col("theta")).when(inside, step).otherwise(half).alias("theta"),
                F.coalesce("low_", "low").alias("low"), F.coalesce("high_", "high").alias("high"),
                (F.col("done") | F.coalesce(near, F.lit(True))).alias("done"),
            ),
            "dual",
        )
    final = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= most * F.col("source_size") * (1 - 1e-12), float(most)).otherwise(rate())
    return hist.join(state, "key").select("key", "size", "docs", "source_size", "target", final.alias("rate"))


def _round_rates(pdf, most: int):
    """Whole copies for the size classes of one source, from the longest to the shortest; what rounding a class adds
    or leaves out in words is carried to the next one, so at the end about half of a short document is left."""
    pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
    carry, out = 0.0, []
    for size, docs, rate in zip(pdf["size"], pdf["docs"], pdf["rate"], strict=True):
        want = docs * rate + (carry / size if size else 0.0)
        copies = min(max(int(want + 0.5), 0), most * docs)
        carry = (want - copies) * size
        out.append(copies)
    return pdf.assign(copies=out)[["key", "size", "docs", "source_size", "target", "rate", "copies"]]


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "size",
) -> DataFrame:
    """How many copies of each document a mixture takes so that every source meets its share of tokens.

    Sources in code-point order, null last, have the weights, repeating; together they get `share` times all tokens,
    each at most `most` times its own. Rates come from `balanced_rates`, over the exact histogram of (source, size).
    They become copies in two steps: every size class gets a whole number, with the rounding carried from longer to
    shorter classes; inside a class the documents that get one copy more are the first by a hash of the id.

    Returns id, key, size, source_size, target, rate, copies. Null sizes count as 0; documents of size 0 follow the
    rate of their class and take no words; null ids and repeated rows are rows like others; an empty table gives no
    rows. Other columns are not read. Reruns agree. A source's size classes (at most as many as the longest document
    has words) meet in one task; its documents never do.
    """
    if not weights or min(weights) < 0 or share < 0 or most < 1:
        raise ValueError("weights and share must not be negative, most must be positive")
    source = F.col(source_col).cast("string")
    sizes = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("0"), source), F.lit(NULL_KEY)).alias("key"),
            F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    hist = saved(sizes.groupBy("key", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    targets = source_targets(sizes, weights, share, most)
    rates = balanced_rates(hist, targets, base=most / 2, most=most)
    schema = "key string, size long, docs long, source_size long, target double, rate double, copies long"
    classes = rates.groupBy("key").applyInPandas(lambda pdf: _round_rates(pdf, most), schema)
    ranked = positions(
        sizes.withColumn("_hash", F.xxhash64(F.col("doc_id"))), ["key", "size", "_hash", "doc_id"], group=["key", "size"]
    )
    extra = F.when(F.col("pos") < F.col("copies") % F.col("docs"), 1).otherwise(0)
    return ranked.join(classes, ["key", "size"]).select(
        "doc_id", "key", "size", "source_size", "target", "rate",
        (F.floor(F.col("copies") / F.col("docs")) + extra).cast("int").alias("copies"),
    )


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: sources weigh 3, 1, 2, repeating, and share 150% of all words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    return mix_sources(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate"
    )
