"""Small helpers that the training-data operators share: tables, cuts of the lineage and distributed positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.words import mix

#: What counts as a word everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on a single machine that names none (tests), a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Arrow batches follow bytes while tables are written, so that long texts don't fill the memory of Python workers.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCHES hold inside; afterwards the session has its own settings again."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back, so a lost executor costs one stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `saved` that nothing will read again: what was made from them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def positions(
    df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), amount: str | None = None
) -> DataFrame:
    """Add `pos`, the 0-based rank of each row, and with `amount` also `before`, the sum of that column over earlier
    rows; both count within `group`.

    The rows are range-partitioned by `order`, which must begin with the columns of `group` and end with a unique
    one; each partition counts on its own and starts from the totals of the partitions before it. So no task sees
    more than its range, whatever a group's size. Columns of `group` must not be null.
    """
    parts = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = {"_rows": F.count(F.lit(1))} | ({"_amount": F.sum(amount)} if amount else {})
    totals = parts.groupBy("_part", *group).agg(*[c.alias(k) for k, c in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part", *group, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_start") for k in sums]
    )
    local = Window.partitionBy("_part", *group).orderBy(*order)
    out = parts.withColumn("pos", F.row_number().over(local).cast("long") - 1)
    if amount:
        own = local.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    out = out.join(starts, ["_part", *group]).withColumn("pos", F.col("pos") + F.col("_rows_start"))
    if amount:
        out = out.withColumn("before", F.col("before") + F.col("_amount_start"))
    return out.drop("_part", *[f"{k}_start" for k in sums])


def numbered(
    docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()
) -> tuple[DataFrame, int, Callable[..., DataFrame]]:
    """(id, text, columns to keep) of all rows with an id for each row, bits of it that tell rows of one given id
    apart, and what puts the given ids back into columns.

    Where each row has an id of its own, that id stays and the bits are 0. Else rows are numbered: a row's id is the
    place of its given id among all rows, nulls last and each for itself, and in the low bits its place among the rows
    of that id, by text. So ids without the low bits are in the order of the given ones.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), *keep)
    times = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").agg(F.max("n")).first()[0]
    if times is None:
        return rows, 0, lambda df, **names: df.withColumnsRenamed(names)
    base = saved(rows.withColumn("_mark", F.monotonically_increasing_id()), "rows")
    light = base.select("id", "_mark", F.col("id").isNull().alias("_none"), F.md5("text").alias("_digest"))
    placed = saved(positions(light.withColumn("_key", F.coalesce("id", F.lit(0))), ["_none", "_key", F.desc("_digest"), "_mark"]), "places")
    first = placed.where("id is not null").groupBy("id").agg(F.min("pos").alias("_first"))
    bits = int(times - 1).bit_length()
    own = F.coalesce("_first", "pos")
    names = saved(placed.join(first, "id", "left").select("_mark", F.col("id").alias("given"), (F.shiftleft(own, bits) + F.col("pos") - own).alias("id")), "names")
    source = saved(base.drop("id").join(names.select("_mark", "id"), "_mark").select("id", "text", *keep), "rows")
    discard(base, placed)

    def back(df: DataFrame, **renamed: str) -> DataFrame:
        for now, name in renamed.items():
            known = names.select(F.col("id").alias("_id"), F.col("given").alias("_given"))
            df = df.join(known, F.col(now) == F.col("_id"), "left").withColumn(now, F.col("_given")).drop("_id", "_given").withColumnRenamed(now, name)
        return df

    return source, bits, back


#: Bits of an id filter: 4 MB, whatever the input. Beyond some ten million ids it passes ever more rows, and the exact
#: join behind it has more to do; no result depends on it.
FILTER_BITS = 1 << 25


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.uint64), 7)
    return np.stack([(h >> np.uint64(s)) % np.uint64(FILTER_BITS) for s in (0, 13, 31)])


def _ids(batch: pa.RecordBatch, col: str) -> np.ndarray:
    return batch.column(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of fixed size over a column of long ids, built by the tasks and merged with bit_or."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_filter_bits(_ids(batch, col)))
            word, at = np.unique(bits >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), at) if len(bits) else bits
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["w", "m"])

    merged = ids.select(col).mapInArrow(words, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)  # at most this many rows come back
    table[merged["w"].to_numpy()] = merged["m"].to_numpy()
    return table.view(np.uint64)


def within(batches: Iterator[pa.RecordBatch], col: str, table: np.ndarray, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose id may be in the filter (`inside`), or the rows whose id surely isn't."""
    for batch in batches:
        hit = np.ones(batch.num_rows, bool)
        for bits in _filter_bits(_ids(batch, col)):
            hit &= (table[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
        yield batch.filter(pa.array(hit == inside))


def kept_ids(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of `docs` whose id is in `ids` (unique), with the columns of `ids`; only likely rows are shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(id_filter(ids, col))
    likely = docs.mapInArrow(lambda it: within(it, col, table.value, True), docs.schema)
    return likely.join(ids, col)


def without_ids(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of `docs` whose id isn't in `ids`; only the rows that may be in it are shuffled."""
    return map_without_ids(docs, ids, col, lambda it: it, docs.schema)


def map_without_ids(
    docs: DataFrame,
    ids: DataFrame,
    col: str,
    f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """mapInArrow over the rows of `docs` whose id isn't in `ids`; only the rows that may be in it are shuffled."""
    table = docs.sparkSession.sparkContext.broadcast(id_filter(ids, col))
    certain = docs.mapInArrow(lambda it: f(within(it, col, table.value, False)), schema)
    doubtful = docs.mapInArrow(lambda it: within(it, col, table.value, True), docs.schema)
    return certain.unionByName(doubtful.join(ids.select(col), col, "left_anti").mapInArrow(f, schema))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of an undirected edge list (a, b): the smallest node it can reach.

    Alternating large-star and small-star steps, each two aggregations and a join over edges; a hub's edges are spread
    by the partial aggregation and by skew joins. The number of rounds follows the logarithm of the longest path. Edges
    of earlier rounds are deleted.
    """
    def state(e: DataFrame) -> tuple:
        """Equal for equal sets of edges; for others with a chance of 2**-128."""
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), label)
    known = state(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u != v").distinct()
        )
        small = saved(small, label)
        discard(edges, large)
        edges, before, known = small, known, state(small)
        if known == before:
            break
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
