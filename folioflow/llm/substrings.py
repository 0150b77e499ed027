"""Removal of repeated word windows, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import discard, kept_ids, map_without_ids, numbered, saved, table
from folioflow.llm.words import Words, blocks, mix

#: A difference cover: for any i and j some d below PERIOD puts both i + d and j + d in COVER modulo PERIOD.
PERIOD, COVER = 7, (1, 2, 4)
#: Anchors or windows in one bucket of the exchange, on average.
BUCKET = 1 << 19


def _table(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: its words, two hashes of their sequence, and the digest of all words."""
    for batch in blocks(batches):
        words = Words(batch.column("text"))
        n = np.diff(words.first)
        sums = []
        for seed in (0, 1):
            at = np.arange(len(words.row), dtype=np.uint64) - np.repeat(words.first[:-1], n).astype(np.uint64)
            total = np.r_[np.uint64(0), np.cumsum(mix(words.hashes(seed) + mix(at, 3), seed), dtype=np.uint64)]
            sums.append(mix(total[words.first[1:]] - total[words.first[:-1]] + n.astype(np.uint64), seed).view(np.int64))
        raw = words.bytes.tobytes()
        sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        yield _table(id=batch.column("id"), n_words=n.astype(np.int64), t1=sums[0], t2=sums[1], sha=sha)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.r_[0, np.flatnonzero(np.diff(sorted_keys)) + 1] if len(sorted_keys) else np.zeros(0, np.int64)


def _by_id(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Values packed as bytes for each id; the values of one id in ascending order, each once."""
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
    ids, values = ids[fresh], values[fresh]
    at = _runs(ids)
    return ids[at], [v.tobytes() for v in np.split(values, at[1:])] if len(at) else []


def _pack(bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket, with the bytes of each column."""
    order = np.argsort(bucket, kind="stable")
    at = _runs(bucket[order])
    if len(at):
        packed = {k: pa.array([x.tobytes() for x in np.split(v[order], at[1:])], pa.binary()) for k, v in columns.items()}
        yield _table(bucket=bucket[order][at].astype(np.int32), **packed)


def _read(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.as_py() is not None), dtype)


def _known(ids: np.ndarray, bits: int) -> np.ndarray:
    """Buckets below 0 for answers that a block has already: dealt by document, so that none fills with a passage."""
    return -1 - (mix(ids.astype(np.uint64), 9) % np.uint64(1 << bits)).astype(np.int64)


def _ask_anchors(batches: Iterator[pa.RecordBatch], size: int, bits: int, ties: int) -> Iterator[pa.RecordBatch]:
    """Anchors at cover positions, packed by bucket. A block sends an anchor once, and twice (with the smallest and
    the largest id) if several of its documents have it; for those in between the answer is known. Ids that agree but
    for the last `ties` bits are rows of one given id."""
    length = size - PERIOD + 1
    for batch in blocks(batches):
        words = Words(batch.column("text"))
        at, h = words.windows(words.hashes(), length)
        on = np.isin((at - words.first[words.row[at]]) % PERIOD, COVER)
        ids, h = batch.column("id").to_numpy()[words.row[at[on]]], h[on]
        order = np.lexsort((ids, h))
        ids, h = ids[order], h[order]
        at = _runs(h)
        end = np.r_[at[1:], len(h)].astype(np.int64)
        n = np.diff(np.r_[at, len(h)])
        low, high = np.repeat(ids[at], n), np.repeat(ids[end - 1], n)
        edge = np.zeros(len(h), bool)
        edge[at] = edge[end - 1] = True
        inner = ~edge & (ids != low) & (low >> ties != high >> ties)
        first = np.zeros(len(h), bool)
        first[at] = True
        ask = first | ((ids != low) & ~inner)
        yield from _pack((h[ask] >> np.uint64(64 - bits)).astype(np.int64), h=h[ask], id=ids[ask])
        yield from _pack(_known(ids[inner], bits), h=h[inner], id=ids[inner])


def _repeated_anchors(rows: pa.Table, ties: int) -> pa.Table:
    """Of one bucket: the anchors that several documents have, by document."""
    h, ids = _read(rows["h"], np.uint64), _read(rows["id"], np.int64)
    if rows["bucket"][0].as_py() >= 0:
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        at = _runs(h)
        n = np.diff(np.r_[at, len(h)])
        several = np.repeat(np.minimum.reduceat(ids, at) >> ties != np.maximum.reduceat(ids, at) >> ties, n)
        h, ids = h[several], ids[several]
    owner, packed = _by_id(ids, h)
    return pa.table({"id": pa.array(owner, pa.int64()), "anchors": pa.array(packed, pa.binary())})


def _ask_windows(batches: Iterator[pa.RecordBatch], size: int, bits: int, ties: int) -> Iterator[pa.RecordBatch]:
    """Windows that hold a repeated anchor, packed by bucket. Where documents of one block share a window, only the
    smallest id asks; for the others the answer is known."""
    length = size - PERIOD + 1
    for batch in blocks(batches):
        words = Words(batch.column("text"))
        hashes = words.hashes()
        at, h = words.windows(hashes, length)
        lists = batch.column("anchors")
        flagged = np.zeros(len(words.row) + 1, np.int64)
        edges = np.searchsorted(at, words.first)
        for i in range(batch.num_rows):
            a, b = edges[i], edges[i + 1]
            found = np.sort(np.frombuffer(b"".join(x.as_buffer() for x in lists[i].values), np.uint64))
            where = np.minimum(np.searchsorted(found, h[a:b]), len(found) - 1)
            on = np.isin((at[a:b] - words.first[i]) % PERIOD, COVER)
            flagged[at[a:b][(found[where] == h[a:b]) & on] + 1] = 1
        upto = np.cumsum(flagged)
        starts, w = words.windows(hashes, size)
        near = upto[np.minimum(starts + PERIOD, len(upto) - 1)] > upto[starts]
        starts, w = starts[near], w[near]
        check = words.windows(words.hashes(1), size, 1)[1][near] if len(starts) else w
        ids, pos = batch.column("id").to_numpy()[words.row[starts]], starts - words.first[words.row[starts]]
        order = np.lexsort((pos, ids, check, w))
        w, check, ids, pos = w[order], check[order], ids[order], pos[order]
        known = _later(ids, (w, check), ties)
        bucket = np.where(known, _known(ids, bits), (w >> np.uint64(64 - bits)).astype(np.int64))
        for which in (~known, known):
            yield from _pack(
                bucket[which], h=w[which], check=(check[which] >> np.uint64(32)).astype(np.uint32), id=ids[which],
                pos=pos[which].astype(np.uint32),
            )


def _later(ids: np.ndarray, keys: tuple[np.ndarray, ...], ties: int) -> np.ndarray:
    """Of rows sorted by keys and then ids: which have a larger given id than the first row of their keys."""
    first = np.ones(len(ids), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    low = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))] if len(ids) else ids
    return ids >> ties != low >> ties


def _repeated_windows(rows: pa.Table, ties: int) -> pa.Table:
    """Of one bucket: where documents have windows that a document with a smaller id has too."""
    ids, pos = _read(rows["id"], np.int64), _read(rows["pos"], np.uint32)
    if rows["bucket"][0].as_py() >= 0:
        h, check = _read(rows["h"], np.uint64), _read(rows["check"], np.uint32)
        order = np.lexsort((ids, check, h))
        ids, pos = ids[order], pos[order]
        again = _later(ids, (h[order], check[order]), ties)
        ids, pos = ids[again], pos[again]
    owner, packed = _by_id(ids, pos)
    return pa.table({"id": pa.array(owner, pa.int64()), "windows": pa.array(packed, pa.binary())})


def _remove(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The words that no repeated window covers, joined by one space."""
    for batch in blocks(batches):
        words = Words(batch.column("text"))
        raw, kept, removed = words.bytes.tobytes(), [], []
        for i, lists in enumerate(batch.column("windows")):
            a, n = words.first[i], words.first[i + 1] - words.first[i]
            starts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in lists.values]).astype(np.int64)
            edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + size, n), minlength=n + 1)
            keep = np.flatnonzero(np.cumsum(edge[:n]) == 0) + a
            kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep], words.ends[keep], strict=True)]).decode())
            removed.append(n - len(keep))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept]
        yield _table(id=batch.column("id"), n_removed=np.array(removed, np.int64), new_sha=sha, kept_text=kept)


def drop_repeated_windows(
    docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Remove every word that lies in a window of `size` words which also starts in a document with a smaller id.

    Texts with the same words form classes; only the smallest id of a class goes on, the other members lose all their
    words (if they have a window). Any two equal windows share an aligned anchor of `size` - 6 words at a cover
    position modulo 7. Anchors meet in buckets; the documents whose anchors repeat are read again, the matches are
    extended to all windows around repeated anchors, and these meet in buckets as 96-bit hashes with the smallest id
    that has them. Blocks of documents settle what they share among themselves: to the bucket of a passage that a third
    of all documents hold a block sends one or two entries, and the answers it has go by document.

    Returns id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and with `with_text` also
    kept_text, null where nothing is removed. Null texts have no words. Ids are integers; a null id counts as larger
    than all others, and each row with one as a document of its own. Rows that repeat an id are documents that don't
    remove each other's words. An empty table gives no rows; other columns are not read.
    """
    if size < PERIOD + 1:
        raise ValueError(f"windows need at least {PERIOD + 1} words")
    source, ties, given = numbered(docs, id_col, text_col)
    profile = saved(source.mapInArrow(_profile, "id long, n_words long, t1 long, t2 long, sha string"), "profiles")
    classes = profile.where(F.col("n_words") >= size).groupBy("t1", "t2", "n_words").agg(F.min("id").alias("low"))
    later = F.shiftright("id", ties) > F.shiftright("low", ties)
    copies = saved(
        profile.where(F.col("n_words") >= size).join(classes, ["t1", "t2", "n_words"]).where(later).select("id"), "copies"
    )
    total = profile.agg(F.sum("n_words")).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, total * len(COVER) / PERIOD / BUCKET)))))
    asked = map_without_ids(source, copies, "id", lambda it: _ask_anchors(it, size, bits, ties), "bucket int, h binary, id binary")
    anchors = asked.groupBy("bucket").applyInArrow(lambda t: _repeated_anchors(t, ties), "id long, anchors binary")
    anchors = anchors.groupBy("id").agg(F.collect_list("anchors").alias("anchors"))  # a document's own
    anchors = saved(anchors, "anchors")
    near = kept_ids(source, anchors, "id").mapInArrow(
        lambda it: _ask_windows(it, size, bits, ties), "bucket int, h binary, check binary, id binary, pos binary"
    )
    windows = near.groupBy("bucket").applyInArrow(lambda t: _repeated_windows(t, ties), "id long, windows binary")
    windows = saved(windows.groupBy("id").agg(F.collect_list("windows").alias("windows")), "windows")
    discard(anchors)
    cut = kept_ids(source, windows, "id").mapInArrow(
        lambda it: _remove(it, size), "id long, n_removed long, new_sha string, kept_text string"
    )
    cut = saved(cut if with_text else cut.drop("kept_text"), "cut")
    discard(windows)
    copied = F.col("copy").isNotNull()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = profile.join(copies.withColumn("copy", F.lit(True)), "id", "left").join(cut, "id", "left").select(
        "id",
        "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, nothing).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        *([F.when(copied, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return given(out, id=id_col)


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that a document with a smaller id has too."""
    return drop_repeated_windows(table(spark, sf_dir, "documents"))
