"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import components, discard, saved, table
from folioflow.llm.topk import valid_vectors

#: Vectors, chosen by a hash of the id, on which the quantisers of a length are fitted; all vectors are indexed.
SAMPLE = 16384
#: Lengths of vectors that get fitted quantisers, the most frequent first; others make one list each, without codes.
LENGTHS = 16
#: Members of one inverted list (or of a part of a long one) in a unit of work.
UNIT_ROWS = 1024


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; an emptied centre stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centres and, for the residuals of unit vectors, a codebook per subspace."""

    def __init__(self, unit: np.ndarray, lists: int, subspaces: int = 16, codes: int = 64) -> None:
        self.coarse = k_means(unit, min(lists, len(unit)))
        residual = unit - self.coarse[_nearest(unit, self.coarse)]
        self.cuts = np.array_split(np.arange(unit.shape[1]), min(subspaces, unit.shape[1]))
        self.books = [k_means(residual[:, c], min(codes, len(unit))) for c in self.cuts]

    @classmethod
    def plain(cls, width: int) -> Quantiser:
        """One list, and codes that stand for nothing: all pairs of the list are compared."""
        return cls(np.zeros((1, width)), lists=1, subspaces=1, codes=1)

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and each vector's distance from what its codes stand for."""
        residual = unit - self.coarse[home]
        codes = np.stack([_nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        back = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(1))

    def tables(self, unit: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of each vector's residual in this list to all codes, by subspace."""
        residual, n = unit - self.coarse[cell], max(map(len, self.books))
        out = np.full((len(unit), len(self.books), n), np.inf)
        for s, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, s, : len(book)] = (residual[:, c, None] ** 2).sum(1) - 2 * residual[:, c] @ book.T + (book**2).sum(1)
        return out

    def probes(self, unit: np.ndarray, reach: float) -> list[np.ndarray]:
        """The lists of each vector, home first. Of two vectors nearer than `reach`, one probes the other's home:
        else both would be further than reach / 2 on their own side of the plane between the two centres."""
        d2 = (self.coarse**2).sum(1) - 2 * unit @ self.coarse.T
        home = np.argmin(d2, axis=1)
        gap = np.sqrt(np.maximum(0, (self.coarse**2).sum(1)[:, None] - 2 * self.coarse @ self.coarse.T + (self.coarse**2).sum(1)))
        near = d2 - d2[np.arange(len(unit)), home][:, None] <= reach * gap[home] + 1e-9
        near[np.arange(len(unit)), home] = False
        return [np.r_[h, np.flatnonzero(x)].astype(np.int32) for h, x in zip(home, near, strict=True)]


def _unit(packed: list[bytes]) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so that none over- or underflows."""
    rows = np.stack([np.frombuffer(x, np.float64) for x in packed])
    rows = rows / np.abs(rows).max(axis=1)[:, None]
    return rows / np.sqrt((rows**2).sum(1))[:, None]


def _of(quantisers: dict[int, Quantiser], width: int) -> Quantiser:
    return quantisers.get(width) or quantisers.setdefault(width, Quantiser.plain(width))


def _listed(batches: Iterator[pa.RecordBatch], quantisers: dict[int, Quantiser], reach: float) -> Iterator[pa.RecordBatch]:
    """A row per vector and list that it is in or probes."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            part = batch.take(pa.array(np.flatnonzero(widths == width)))
            lists = _of(quantisers, width).probes(_unit(part.column("v").to_pylist()), reach)
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in lists]))
            rows = part.take(at)
            probes = pa.array([x.tobytes() for x in lists], pa.binary()).take(at)
            home = pa.array(np.array([x[0] for x in lists], np.int32)).take(at)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(lists)), home, probes], [*rows.schema.names, "cell", "home", "probes"])


def _united(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): each row has the least label that it can reach."""
    while True:
        new = top.copy()
        np.minimum.at(new, a, top[b])
        np.minimum.at(new, b, top[a])
        np.minimum.at(new, top, new)  # what a member reaches, its label reaches
        new = new[new]
        if np.array_equal(new, top):
            return top
        top = new


def _compare(rows: pa.Table, quantisers: dict[int, Quantiser], least: float) -> pa.Table:
    """Of one unit: per vector the weight of its links, and links that join what is linked."""
    ids, copies, home, mine = (rows[c].to_numpy() for c in ("id", "copies", "home", "mine"))
    cell, x, y = (int(rows[c][0].as_py()) for c in ("cell", "x", "y"))
    q = _of(quantisers, int(rows["width"][0].as_py()))
    packed = rows["v"].to_pylist()
    unit = _unit(packed)
    probes = [np.frombuffer(p, np.int32) for p in rows["probes"].to_pylist()]
    probed = np.sort(np.repeat(np.arange(len(ids)), [len(p) for p in probes]) * np.int64(len(q.coarse)) + np.concatenate(probes))
    own = np.flatnonzero(home == cell)
    count, top = np.zeros(len(ids), np.int64), np.arange(len(ids))
    codes, off = q.encode(unit[own], np.full(len(own), cell)) if len(own) else (np.zeros((0, len(q.books)), np.uint8), np.zeros(0))
    reach = np.sqrt(2 - 2 * least)
    for s in range(0, len(ids) if len(own) else 0, 256):
        asks = np.arange(s, min(s + 256, len(ids)))
        tables = q.tables(unit[asks], cell)
        d2 = sum(tables[:, k, :][:, codes[:, k]] for k in range(codes.shape[1]))
        a, b = np.nonzero(d2 <= ((reach + off) ** 2)[None, :] + 1e-7)
        g, h = asks[a], own[b]
        on = (g != h) & ((mine[g] != mine[h]) if x != y else True)
        on &= (home[g] != cell) | (ids[g] < ids[h])  # two members of the list meet twice
        g, h = g[on], h[on]
        on = np.einsum("ij,ij->i", unit[g], unit[h]) >= least
        g, h = g[on], h[on]
        # where each probes the other's list, the list of the smaller number has the pair
        code = h * np.int64(len(q.coarse)) + home[g]
        both = probed[np.minimum(np.searchsorted(probed, code), len(probed) - 1)] == code
        on = ~((home[g] < cell) & both)
        g, h = g[on], h[on]
        np.add.at(count, g, copies[h])
        np.add.at(count, h, copies[g])
        top = _united(top, g, h)
    some, joined = np.flatnonzero(count), np.flatnonzero(top != np.arange(len(ids)))
    return pa.table(
        {
            "id": np.r_[ids[some], ids[joined]],
            "n": np.r_[count[some], np.zeros(len(joined), np.int64)],
            "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[top[joined]])]),
        }
    )


def _fitted(classes: DataFrame) -> dict[int, Quantiser]:
    """Quantisers by length of vector, of the LENGTHS most frequent ones; the lists follow the root of the vectors' number."""
    out = {}
    for width, n in classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(LENGTHS).collect():
        sample = classes.where(F.col("width") == width).orderBy(F.xxhash64("low"), "low").select("v").limit(SAMPLE).toArrow()["v"].to_pylist()
        out[width] = Quantiser(_unit(sample), lists=max(1, min(int(n**0.5), len(sample) // 64)))
    return out


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Link vectors of one label whose cosine is at least `least`, and give each its links and component.

    Equal vectors of a label form classes, of which one goes on. Coarse centres and residual codebooks are fitted on
    at most SAMPLE vectors; every vector is coded and listed with its nearest centre, and compared in all lists whose
    centre isn't further than the bound that no pair can hide behind. There the table distance to the codes, less the
    coding error that each entry keeps, rules pairs out without loss, and the rest is compared exactly. Long lists
    are cut into blocks, every two of which are a unit; links are counted in the unit, not sent.

    Returns id, n_links (other ids linked directly), component_id (smallest id reachable), kept. Rows whose label is
    null or whose vector is null, zero or holds null or non-finite components link with nothing; nor do vectors of
    different lengths. Cosines are those of vectors scaled by their largest component, so that finite ones neither
    over- nor underflow. Null ids link with nothing; of rows that repeat an id, the one with the least label and
    vector among those that can link stands for all, once. An empty table gives no rows; other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    good = rows.where("label is not null").mapInArrow(valid_vectors, "id long, v binary, norm double, label string").where("norm > 0")
    good = saved(good.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*"), "vectors")
    classes = saved(
        good.groupBy("label", "v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
        .withColumn("width", (F.octet_length("v") / 8).cast("int")), "vector-classes"
    )
    shared = vectors.sparkSession.sparkContext.broadcast(_fitted(classes))
    reach = float(np.sqrt(2 - 2 * least))
    listed = classes.select(F.col("low").alias("id"), "v", "label", "copies", "width").mapInArrow(
        lambda it: _listed(it, shared.value, reach), "id long, v binary, label string, copies long, width int, cell int, home int, probes binary"
    )
    listed = saved(listed, "listed")
    whole = listed.groupBy("label", "width", "cell").agg(F.ceil(F.count(F.lit(1)) / UNIT_ROWS).cast("int").alias("cuts"))
    units = (
        listed.join(whole, ["label", "width", "cell"])
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
        .drop("other", "cuts")
    )
    compared = units.groupBy("label", "width", "cell", "x", "y").applyInArrow(
        lambda t: _compare(t, shared.value, least), "id long, n long, other long"
    )
    none = saved(compared, "compared")
    discard(listed)
    counts = none.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(none.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    reps = (
        classes.join(counts.withColumnRenamed("id", "low"), "low", "left")
        .join(joined.withColumnRenamed("node", "low"), "low", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    )
    known = good.join(reps, ["label", "v"]).select("id", "n_links", "component_id")
    return rows.select("id").join(known, "id", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 and more among all embeddings of equal label."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
