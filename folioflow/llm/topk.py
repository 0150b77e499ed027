"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, positions, saved, table

#: From this local cosine threshold a bucket is pruned by coordinates, below it by length.
BY_COORDINATES = 0.75
#: Coordinates looked at when pruning by coordinates.
FOCUS = 4


#: Vectors of this norm and more are compared in Python's integers: below it products are exact in doubles.
HUGE = 2.0**26
#: The largest score that the result's type holds.
MOST = (1 << 63) - 1


def _norms(flat: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Norms of the rows edge[i]..edge[i + 1], taken relative to the largest component: they are 0 for zeros only, and
    none is infinite."""
    most, sums, some = np.zeros(len(edge) - 1), np.zeros(len(edge) - 1), np.diff(edge) > 0
    if some.any():
        most[some] = np.maximum.reduceat(np.abs(flat), edge[:-1][some])
        part = flat / np.repeat(np.where(most > 0, most, 1), np.diff(edge))
        sums[some] = np.add.reduceat(part * part, edge[:-1][some])
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(sums), np.finfo(float).max)


def _packed(flat: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def valid_vectors(batches: Iterator[pa.RecordBatch], scale: float | None = None) -> Iterator[pa.RecordBatch]:
    """(id, v as packed doubles, norm, then the other columns) of the rows whose vector is neither null nor holds null, NaN or infinity. With
    `scale` the components become floor(scale * x), but for vectors whose norm is then HUGE or more: these stay."""
    for batch in batches:
        lists, ids = batch.column("v"), batch.column("id")
        start = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
        ok = (bad[start[1:]] == bad[start[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
        n = np.diff(start)
        flat, edge = flat[start[0] : start[-1]][np.repeat(ok, n)], np.r_[0, np.cumsum(n[ok])]
        norms = _norms(flat, edge)
        if scale is not None:
            with np.errstate(over="ignore"):
                y = np.clip(np.floor(scale * flat), -1e300, 1e300)
            norms = _norms(y, edge)
            flat = np.where(np.repeat(norms >= HUGE, n[ok]), flat, y)
        others = [c for c in batch.schema.names if c not in ("id", "v")]
        kept = [batch.column(c).filter(pa.array(ok)) for c in others]
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), _packed(flat, edge), pa.array(norms), *kept], ["id", "v", "norm", *others])


def _integers(packed: bytes, norm: float, scale: float) -> list[int]:
    """The components of floor(scale * x) without a limit to their size."""
    v = np.frombuffer(packed, np.float64).tolist()
    return [floor(Fraction(x) * Fraction(scale)) for x in v] if norm >= HUGE else [int(x) for x in v]


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    out = np.zeros((len(packed), width))
    for row, x in zip(out, packed, strict=True):
        v = np.frombuffer(x, np.float64)
        row[: len(v)] = v
    return out


def _candidates(unit: np.ndarray, q: np.ndarray, least: float, by: np.ndarray) -> np.ndarray:
    """Rows of unit vectors whose cosine with the unit vector q can reach `least`, judged by q's largest coordinates:
    a coordinate p of such a row lies within sqrt((1 - q^2)(1 - least^2)) of q * least, or nearer to q."""
    on = np.ones(len(unit), bool)
    for f in by:
        room = np.sqrt(max(0.0, (1 - q[f] ** 2) * (1 - least**2))) + 1e-9
        low, high = q[f] * least - room, q[f] * least + room
        if q[f] > least:
            high = 1.0
        if q[f] < -least:
            low = -1.0
        on &= (unit[:, f] >= low) & (unit[:, f] <= high)
    return np.flatnonzero(on)


def _search(rows: pa.Table, k: int, scale: float) -> pa.Table:
    """The best k of one group of buckets for one group of queries."""
    asks = rows["ask"].to_numpy(zero_copy_only=False)
    every = rows["v"].to_pylist()
    width = max(len(x) for x in every) // 8
    ids, norms, bucket, floors = (rows[c].to_numpy(zero_copy_only=False) for c in ("id", "norm", "bucket", "floor"))
    huge = norms >= HUGE
    at_q, at_c = np.flatnonzero(asks), np.flatnonzero(~asks)
    best: list[list[tuple[int, int]]] = [[] for _ in at_q]  # (-score, id), ascending
    least = floors[at_q].copy()

    def keep(row: int, found: list[tuple[int, int]]) -> None:
        best[row] = sorted(best[row] + [x for x in found if x[1] != ids[at_q[row]]])[:k]
        if len(best[row]) == k:
            least[row] = max(least[row], min(float(-best[row][-1][0]), HUGE**2))

    def keep_all(row: int, scores: np.ndarray, own: np.ndarray) -> None:
        keep(row, list(zip((-scores).astype(np.int64).tolist(), own.tolist(), strict=True)))

    if huge.any():
        whole = {i: _integers(every[i], norms[i], scale) for i in (at_c if huge[at_q].any() else at_c[huge[at_c]]).tolist()}
        for row, i in enumerate(at_q.tolist()):
            q = _integers(every[i], norms[i], scale)
            keep(row, [(-max(-MOST, min(MOST, sum(map(mul, q, whole[c])))), int(ids[c])) for c in whole if huge[i] or huge[c]])
    q_all = _matrix([every[i] for i in at_q], width)
    q_norm = norms[at_q]
    plain = ~huge[at_q]
    at_c = at_c[~huge[at_c]]
    for b in np.unique(bucket[at_c]):
        own = at_c[bucket[at_c] == b]
        own = own[np.argsort(-norms[own], kind="stable")]
        c, c_norm, c_ids = _matrix([every[i] for i in own], width), norms[own], ids[own]
        top = c_norm[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(q_norm * top > 0, least / (q_norm * top), np.where(least > 0, np.inf, -np.inf))
        live = np.flatnonzero((local <= 1 + 1e-12) & plain)
        narrow, broad = live[local[live] >= BY_COORDINATES], live[local[live] < BY_COORDINATES]
        for s in range(0, len(broad), 128):
            part = broad[s : s + 128]
            # by length: a row can only reach the threshold if its norm is at least threshold / query norm
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where(q_norm[part] > 0, least[part] / q_norm[part], -np.inf)
            upto = np.searchsorted(-c_norm, -short * (1 - 1e-9) + 1e-9, "right")
            scores = q_all[part] @ c[: max(upto.max(), 1)].T
            for n, row in enumerate(part):
                near = np.flatnonzero(scores[n] >= least[row])
                if len(near) > k:  # ties with the k-th stay
                    near = near[scores[n][near] >= np.partition(scores[n][near], len(near) - k - 1)[len(near) - k - 1]]
                keep_all(row, scores[n][near], c_ids[near])
        if len(narrow):
            unit = c / np.maximum(c_norm, 1e-300)[:, None]
            for row in narrow:
                q = q_all[row] / q_norm[row]
                near = _candidates(unit, q, max(0.0, local[row]), np.argsort(-np.abs(q))[:FOCUS])
                scores = c[near] @ q_all[row]
                on = scores >= least[row]
                keep_all(row, scores[on], c_ids[near[on]])
    flat = [(int(ids[at_q[row]]), i, -s) for row, found in enumerate(best) for s, i in found]
    return pa.table({name: pa.array([x[j] for x in flat], pa.int64()) for j, name in enumerate(("query_id", "vec_id", "score"))})


def top_inner_products(
    vectors: DataFrame,
    is_query: str,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket_rows: int = 2048,
    query_rows: int = 512,
    buckets_together: int = 4,
) -> DataFrame:
    """The k largest inner products of each query (rows where the SQL condition `is_query` on `id` holds) with all
    other rows, on integer vectors floor(scale * x); ties go to the smaller id.

    Rows in descending order of norm form buckets. Every query first meets the bucket of longest rows, whose k-th
    score is a lower bound of its k-th best. Queries with like bounds, relative to their norms, form blocks, and a
    block meets only the groups of buckets whose longest row can reach the bound of one of its queries. There, in a
    task, a bucket is skipped where even its longest row at cosine 1 stays below the bound; else the local cosine
    threshold, bound / (query norm * longest norm), decides between pruning rows by their length and pruning them by
    the ranges that the query's largest coordinates leave. What is left is verified by full products, which raises the
    bound.

    Returns query_id, rank, vec_id, score. Null ids and vectors that are null or hold null or non-finite components
    take no part; vectors shorter than others count as filled with zeros; of rows that
    repeat an id the one with the least vector counts, once; an empty table gives no rows. Products are exact, also those of vectors whose norm is HUGE
    or more; scores beyond the range of long are given as its ends, and rank by id where they are equal then.
    """
    if k < 1:
        raise ValueError("k must be positive")
    schema = "id long, v binary, norm double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.mapInArrow(lambda it: valid_vectors(it, scale), schema).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("r"))
    rows = saved(rows.select("id", "r.*"), "vectors")
    ranked = saved(
        positions(rows.withColumn("down", -F.col("norm")), ["down", "id"]).select(
            "id", "v", "norm", F.floor(F.col("pos") / bucket_rows).cast("int").alias("bucket"),
            F.floor(F.col("pos") / (bucket_rows * buckets_together)).cast("int").alias("group"),
        ),
        "buckets",
    )
    discard(rows)

    def blocks_of(queries: DataFrame, *order: str) -> DataFrame:
        return saved(positions(queries, order).select("id", "v", "norm", "floor", "need", F.floor(F.col("pos") / query_rows).cast("int").alias("block")), "queries")

    def met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """The best of every block of queries in the groups that can reach one of its bounds."""
        groups = candidates.groupBy("group").agg(F.max("norm").alias("top"))
        needs = queries.groupBy("block").agg(F.min("need").alias("need"))
        n = (needs.agg(F.max("block")).first()[0] or 0) + 1
        pairs = groups.select("group", "top", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(needs, "block").where("need <= top").select("group", "block")
        c = candidates.join(pairs, "group").select("group", "block", "id", "v", "norm", "bucket", F.lit(float("-inf")).alias("floor"), F.lit(False).alias("ask"))
        q = queries.join(pairs, "block").select("group", "block", "id", "v", "norm", F.lit(-1).alias("bucket"), "floor", F.lit(True).alias("ask"))
        return c.unionByName(q).groupBy("block", "group").applyInArrow(lambda t: _search(t, k, scale), "query_id long, vec_id long, score long")

    none = F.lit(float("-inf"))
    asks = blocks_of(ranked.where(is_query).withColumns({"floor": none, "need": none}), "id")
    first = met(ranked.where("bucket = 0"), asks)
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor"))
    floors = floors.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.least("floor", F.lit(HUGE**2)).alias("known"))
    need = F.when((F.col("norm") > 0) & (F.col("norm") < HUGE) & (F.col("floor") > 0), F.col("floor") / F.col("norm") * (1 - 1e-9)).otherwise(none)
    bounded = asks.drop("floor", "need").join(floors, "id", "left").withColumn("floor", F.coalesce("known", none)).withColumn("need", need)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = met(ranked, blocks_of(bounded, "need", "id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector with all others."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
