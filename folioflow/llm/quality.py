"""A text-quality classifier: generalised additive model with pairwise interactions, boosted cyclically."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import discard, saved, table
from folioflow.llm.words import Words, blocks, mix

#: Labelled rows on which the model is fitted, chosen by a hash of the id.
TRAINING_ROWS = 20000

CLASSES = ("lower", "upper", "digit", "stop", "comma", "mark", "symbol", "line", "blank", "high")
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
_CLASS[[ord(".")]], _CLASS[[ord(",")]], _CLASS[[ord(c) for c in "!?;:'\"()-"]] = 3, 4, 5
_CLASS[10], _CLASS[[9, 11, 12, 13, 32]] = 7, 8

FEATURES = (
    *(f"{c}_share" for c in CLASSES),
    "words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "word_length", "word_length_spread",
    "short_words", "long_words", "capital_words", "shouted_words", "wordless", "odd_ends", "words_per_line",
    "repeated_lines", "words_per_stop", "entropy",
)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each whole text; all 0 for empty texts and nulls."""
    w = Words(texts)
    rows, size = len(texts), np.diff(w.bounds)
    n = np.diff(w.first)
    kind = _CLASS[w.bytes]
    of_byte = np.repeat(np.arange(rows), size)
    counts = np.bincount(of_byte * len(CLASSES) + kind, minlength=rows * len(CLASSES)).reshape(rows, len(CLASSES))
    h, row = w.hashes(), w.row

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=mask, minlength=rows)

    def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, count of the most frequent one and entropy in bits, by row."""
        if not len(keys):
            return np.zeros(rows), np.zeros(rows), np.zeros(rows)
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        at = np.r_[0, np.flatnonzero((np.diff(keys) != 0) | (np.diff(owner) != 0)) + 1]
        times, who = np.diff(np.r_[at, len(keys)]), owner[at]
        top = np.zeros(rows)
        np.maximum.at(top, who, times)
        p = times / np.bincount(owner, minlength=rows)[who]
        return np.bincount(who, minlength=rows), top, np.bincount(who, weights=-p * np.log2(p), minlength=rows)

    unique, top, entropy = distinct(h, row)
    pair_row = row[:-1][row[1:] == row[:-1]] if len(row) else row
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(3) + h[1:], 2)[row[1:] == row[:-1]] if len(row) else h
    unique_pairs, _, _ = distinct(pairs, pair_row)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    length = (w.ends - w.starts).astype(float)
    mean = _share(per_row(length), n)
    spread = np.sqrt(np.maximum(0, _share(per_row(length**2), n) - mean**2))
    first, last = kind[w.starts], kind[w.ends - 1]
    alpha = np.r_[0, np.cumsum((kind == 0) | (kind == 1) | (kind == 9))]
    loud = np.r_[0, np.cumsum(kind == 1)]
    letters, capitals = alpha[w.ends] - alpha[w.starts], loud[w.ends] - loud[w.starts]
    line = np.r_[0, np.cumsum(kind == 7)]
    line_of = line[w.starts]
    starts = np.ones(len(h), bool)
    starts[1:] = (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])
    lines = per_row(starts)
    at = np.flatnonzero(starts)
    sums = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    of_line = sums[np.r_[at[1:], len(h)]] - sums[at] if len(at) else h
    unique_lines, _, _ = distinct(of_line, row[at] if len(at) else row)
    columns = [
        *(_share(counts[:, k], size) for k in range(len(CLASSES))),
        np.log1p(n), _share(unique, n), _share(top, n), _share(per_row(same), n), _share(unique_pairs, n - 1), mean, spread,
        _share(per_row(length <= 2), n), _share(per_row(length >= 14), n), _share(per_row(first == 1), n),
        _share(per_row((capitals >= 2) & (capitals == letters)), n), _share(per_row(letters == 0), n),
        _share(per_row(last == 6), n), _share(n, lines), 1 - _share(unique_lines, lines) * (lines > 0) - (lines == 0),
        _share(n, counts[:, 3]), _share(entropy, np.log2(np.maximum(n, 2))),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables per feature, and tables per pair of features over coarser bins."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: the sum of table entries, through the logistic function."""
        total = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        for t, b in zip(self.tables, bins, strict=True):
            total += t[b]
        for f, g, t in self.pairs:
            total += t[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree of `depth` levels over ordered bins, by the gradient and curvature sums of the bins."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out[:cut], out[cut:] = _shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid of bins into four quadrants: its gain and its values."""
    sums = [np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h)]
    i, j = (np.arange(1, k) for k in g.shape)
    part = []
    for s in sums:
        a = s[np.ix_(i, j)]
        top, left = s[i, -1][:, None], s[-1, j][None, :]
        part.append((a, top - a, left - a, s[-1, -1] - top - left + a))
    gain = sum(_gain(x, y) for x, y in zip(*part, strict=True))
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    a, b = a + 1, b + 1
    for rows in (slice(None, a), slice(a, None)):
        for cols in (slice(None, b), slice(b, None)):
            out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float(gain.max()), out


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.15, pairs: int = 8, pair_bins: int = 8
) -> AdditiveModel:
    """Boost one shallow tree per feature, round after round; then the pairs of features that explain most of what is
    left, cyclically too. Without both classes the model is the smoothed base rate."""
    p = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, pair_bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model = AdditiveModel(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges], coarse)
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            if len(t) > 1:
                g, h = (np.bincount(at[f], weights=s, minlength=len(t)) for s in slopes())
                step = rate * _shallow_tree(g, h)
                t += step
                total += step[at[f]]
    cell = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    shape = [len(e) + 1 for e in coarse]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = shape[f] * shape[k]
        return tuple(np.bincount(cell[f] * shape[k] + cell[k], weights=s, minlength=n).reshape(shape[f], shape[k]) for s in slopes())

    usable = [f for f, n in enumerate(shape) if n > 1]
    ranked = sorted(((_quadrants(*grid(f, k))[0], f, k) for i, f in enumerate(usable) for k in usable[i + 1 :]), reverse=True)
    model.pairs = [(f, k, np.zeros((shape[f], shape[k]))) for _, f, k in ranked[:pairs]]
    for _ in range(rounds // 2):
        for f, k, t in model.pairs:
            step = rate * _quadrants(*grid(f, k))[1]
            t += step
            total += step[cell[f], cell[k]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        x = features(batch.column("text"))
        flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), flat], ["doc_id", "y", "x"])


def _scored(batches: Iterator[pa.RecordBatch], model: AdditiveModel, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, text_col):
        score = model.score(features(batch.column(text_col)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], [*keep, "score"])


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> AdditiveModel:
    """The model of the labelled texts that aren't held out: at most TRAINING_ROWS of them, the first by a hash of the
    id. Labels other than 0 and 1 are left out, of contradicting ones the larger counts, of an id's texts the least."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("y"))
    known = known.where(~held_out()).join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    sample = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS), "sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most TRAINING_ROWS
    learned = saved(texts.mapInArrow(_measured, "doc_id long, y int, x array<double>"), "training")
    rows = learned.orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "y").toArrow()
    discard(sample, learned)
    return fit(np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES)), rows["y"].to_numpy().astype(float))


def with_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep of every row, and the score of its text: one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = list(keep)
    filled = docs.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    schema = filled.select(*keep).schema.add("score", "double")
    return filled.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lambda it: _scored(it, shared.value, text_col, keep), schema)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Score every text by a model that is fitted on the labelled ones that aren't held out.

    Features are counts and shares over the whole text (letters, marks, repeated words and lines, ...). Ids, labels,
    languages and sources are no features.

    Returns id, held_out (crc32 of the id as text leaves 1 modulo 3), score, predicted, one row per row of `docs`.
    Null and empty texts get the score of their (zero) features; null ids are never held out and have no label;
    repeated rows are rows like others; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = saved(with_score(rows, fit_quality(docs, labels, id_col, text_col, label_col), keep=["doc_id", "held_out"]), "scores")
    return scored.select(
        F.col("doc_id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
