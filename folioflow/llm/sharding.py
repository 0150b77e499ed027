"""Balanced shards by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import positions, saved, table


def shard_by_bytes(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.01
) -> DataFrame:
    """Cut the rows into `shards` contiguous ranges of nearly equal bytes.

    The rows are ordered by a digest of the text and then by id, so equal texts lie side by side. Prefix sums over
    this order come from per-partition totals; a row goes to the shard in which the middle of its byte range falls.
    A group of equal texts goes as a whole by the middle of the group, unless the group is over `slack` of a shard:
    then its rows go one by one, so that sizes stay near equal.

    Returns id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (unsigned; of the empty text for null),
    shard and slot (from 0 without gaps in the order above). Null ids sort first; repeated rows each get a slot; an
    empty table gives no rows; other columns of `docs` are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("_digest"),
    )
    placed = saved(positions(rows, ["_digest", "doc_id"], amount="size"), "sharded")
    total = int(placed.agg(F.sum("size")).first()[0] or 0)
    groups = placed.groupBy("_digest").agg(F.min("before").alias("_from"), F.sum("size").alias("_bytes"))
    large = F.broadcast(groups.where(F.col("_bytes") > slack * total / shards).select("_digest"))  # at most shards / slack rows
    single = placed.join(large, "_digest", "left_semi").withColumn("_middle", 2 * F.col("before") + F.col("size"))
    whole = placed.join(large, "_digest", "left_anti").join(groups, "_digest").withColumn("_middle", 2 * F.col("_from") + F.col("_bytes"))
    cut = single.unionByName(whole.drop("_from", "_bytes")).withColumn("shard", F.expr(f"cast(_middle * {shards} div {max(2 * total, 1)} as int)"))
    starts = cut.groupBy("shard").agg(F.min("pos").alias("_start"))
    return cut.join(F.broadcast(starts), "shard").select(  # at most `shards` rows
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("_start")).alias("slot")
    )


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; the law is near-equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
