"""Search terms as 64-bit numbers, made with numpy from the words of an Arrow batch of texts.

A word of up to 8 bytes differs from others of its length for sure; else two terms of a corpus are taken for one with a
chance of n * n / 2**65 for n distinct ones (1 % for 600 million), and then count as one in document frequencies.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first i bytes of a little-endian word
#: Words with more bytes are digested one by one; bytes of texts, and rows, that are worked on together.
LONG, STEP, ROWS = 512, 1 << 21, 1 << 12


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= _K[1]
    x ^= x >> np.uint64(27)
    x *= _K[2]
    x ^= x >> np.uint64(31)
    return x


def _texts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, with 8 more, and where each begins."""
    words = words.cast(pa.large_string())
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, np.int64, len(words) + 1, words.offset * 8) if len(words) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    out = np.zeros(size + 8, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8, size, int(at[0]))
    return out, at - at[0]


def word_ids(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = sizes.astype(np.uint64) * _K[0]
    todo, done = np.flatnonzero(sizes <= LONG), 0
    while len(todo):
        rest = np.minimum(sizes[todo] - done, 8)
        h[todo] = _mixed(h[todo] ^ (eights[starts[todo] + done] & _LOW[rest]))
        done += 8
        todo = todo[sizes[todo] > done]
    for i in np.flatnonzero(sizes > LONG):
        h[i] = int.from_bytes(blake2b(data[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def _counted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = at[1:] > at[:-1]
    blank = np.flatnonzero(data[: at[-1]] == 32)
    starts = np.sort(np.concatenate([at[:-1][full], blank + 1]))
    ends = np.sort(np.concatenate([at[1:][full], blank]))
    words = np.where(full, np.diff(np.searchsorted(blank, at)) + 1, 0)
    h = word_ids(data, starts, ends - starts)
    # of w words in a text come 2 w - 1 terms: after each word but the last stands its pair with the next
    nth = np.repeat(np.cumsum(full) - 1, words)
    place = 2 * np.arange(len(h)) - nth
    terms = np.empty(2 * len(h) - int(full.sum()), np.uint64)
    terms[place] = h
    inner = np.flatnonzero(nth[1:] == nth[:-1])
    terms[place[inner] + 1] = _mixed((h[inner] ^ (h[inner] >> np.uint64(32))) * _K[3] + h[inner + 1])
    edges = np.concatenate([[0], np.cumsum(np.where(full, 2 * words - 1, 0))])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        terms[a:b].sort()
    fresh = np.ones(len(terms), bool)
    fresh[1:] = terms[1:] != terms[:-1]
    fresh[edges[:-1][full]] = True
    first = np.flatnonzero(fresh)
    return terms[first].view(np.int64), np.diff(np.append(first, len(terms))), np.diff(np.searchsorted(first, edges))


def counted_ids(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of search words with a space between: the numbers of their distinct terms, text by text, how often each
    occurs in its text, and how many there are of each text."""
    data, at = _texts(words)
    cuts = [0]  # rows by `STEP` bytes, so that what is made for each byte stays small
    while cuts[-1] < len(words):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + STEP, "right")) - 1))
    parts = [_counted(data[at[a] : at[b] + 8], at[a : b + 1] - at[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def tf(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts.astype(np.float64))  # the logarithm of bytes would have half precision


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def _packed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or 0 <= x.min() and x.max() < 256 else np.int32)


def _unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    """`n` numbers of 1 or 4 bytes each."""
    data = data.as_buffer()
    return np.frombuffer(data, np.uint8 if data.size == n else np.int32)


def _binary(parts: Sequence[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def _give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task shouldn't hold that of the last."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def dealt(batches: Iterator[pa.RecordBatch], labels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each few rows of words, named by their task and number, and each bucket of terms: (label of the bucket, task,
    number, count of rows, how many terms each has there, these, how often each occurs). With the first bucket go the rows'
    keys."""
    buckets, task = len(labels), TaskContext.get().partitionId()
    for number, batch in enumerate(_slices(batches)):
        ids, counts, sizes = counted_ids(batch.column("words"))
        bucket = bucket_of(ids, buckets)
        order = np.argsort(bucket, kind="stable")  # 16-bit numbers are sorted by radix
        row = np.repeat(np.arange(len(sizes)), sizes)
        each = np.bincount(bucket.astype(np.int64) * len(sizes) + row, minlength=buckets * len(sizes)).reshape(buckets, -1)
        cuts = np.cumsum(each.sum(axis=1))[:-1]
        keys = pa.StructArray.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)], batch.schema.names[:-1])
        own = pa.ListArray.from_arrays(pa.array([0] + [len(keys)] * buckets, pa.int32()), keys)
        yield pa.RecordBatch.from_arrays([
            pa.array(labels), pa.array([task] * buckets, pa.int32()), pa.array([number] * buckets, pa.int32()),
            pa.array([len(sizes)] * buckets, pa.int32()), own, _binary([_packed(x) for x in each]), _binary(np.split(ids[order], cuts)), _binary([_packed(x) for x in np.split(counts[order], cuts)]),
        ], ["bucket", "task", "number", "rows", "own", "sizes", "ids", "counts"])
    _give_back()


def stored(batches: Iterator[pa.RecordBatch], good: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of terms and their frequencies, of rows of both, where the number is `good`."""
    for batch in batches:
        for x, y in zip(batch.column("ids"), batch.column("counts"), strict=True):
            ids = np.frombuffer(x.as_buffer(), np.int64)
            counts = _unpacked(y, len(ids)).astype(np.int64)
            some = slice(None) if good is None else np.flatnonzero(good(ids))
            yield ids[some], counts[some]


def dealt_sizes(batches: Iterator[pa.RecordBatch], labels: np.ndarray, good: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """The same as `dealt` of what is stored of terms, which has no keys."""
    for ids, counts in stored(batches, good):
        bucket = bucket_of(ids, len(labels))
        order, each = np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=len(labels))
        some = np.flatnonzero(each)  # one, where buckets were as many when these were stored
        cuts = np.cumsum(each[some])[:-1]
        lists = [_binary(np.split(ids[order], cuts)), _binary([_packed(x) for x in np.split(counts[order], cuts)])] if len(some) else [pa.array([], pa.binary())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(labels[some]), pa.array([0] * len(some), pa.int32()), *lists], ["bucket", "rows", "ids", "counts"])


def frequencies(batches: Iterator[pa.RecordBatch], good: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """(term, df) of the same."""
    for ids, counts in stored(batches, good):
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["term", "df"])


class Seen:
    """A filter of 4 MB that lets through all numbers that it was made of, and some others."""

    BITS, PIECES = 1 << 25, 64

    def __init__(self, pieces: dict[int, bytes]) -> None:
        none = bytes(self.BITS // 8 // self.PIECES)
        self.bits = np.frombuffer(b"".join(pieces.get(i, none) for i in range(self.PIECES)), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        at = ids & (self.BITS - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    @classmethod
    def pieces(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(piece, bits) of a task's rows of words."""
        seen = np.zeros(cls.BITS, bool)
        for batch in _slices(batches):
            seen[counted_ids(batch.column("words"))[0] & (cls.BITS - 1)] = True
        parts = np.packbits(seen, bitorder="little").reshape(cls.PIECES, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _binary(list(parts[some]))], ["piece", "bits"])

    @staticmethod
    def either(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": _binary([bits])})


#: Terms of a bucket that are sorted together.
SORTED = 1 << 19


def ranges(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Places of numbers, a range of numbers (by their lowest bits) at a time."""
    n = min(max(1, len(ids) // SORTED), 1 << 16)
    lot = ids.view("<u2")[::4] % np.uint16(min(n, (1 << 16) - 1)) if n > 1 else None
    for r in range(n):
        yield np.flatnonzero(lot == r) if n > 1 else np.arange(len(ids))


def starts(found: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)


#: Signs of rows: of what is stored, of rows that are added or taken away, and of rows that are weighed only.
STORED, ADDED, GONE, WEIGHED = 0, 1, -1, 2


def met(batches: Iterator[pa.RecordBatch], n: int, before: int, part: int, tell: bool = True) -> Iterator[pa.RecordBatch]:
    """What the rows of a bucket, dealt words and stored numbers, give: (task, number, own, sums) with the sum of squared
    weights of each row's terms, idf being that of all rows among `n`. And, if that is wanted, with task -1, by ranges of
    terms: the least ratio of idf to that among `before` stored rows, terms that were added more often than `part` times,
    with their numbers, and all terms that were added or taken away, with their change."""
    kept, signs, terms, ids, counts, sizes = [], [], [], [], [], []
    for part_of in batches:  # Arrow's copies of numbers go when they are joined
        for i, (sign, rows) in enumerate(zip(part_of.column("sign").to_pylist(), part_of.column("rows").to_pylist(), strict=True)):
            ids.append(np.frombuffer(part_of.column("ids")[i].as_buffer(), np.int64))
            counts.append(_unpacked(part_of.column("counts")[i], len(ids[-1])))
            signs.append(sign), terms.append(len(ids[-1]))
            if sign > 0:
                sizes.append(_unpacked(part_of.column("sizes")[i], rows).copy())
        kept.append(part_of.select(["task", "number", "own"]).filter(pc.greater(part_of.column("sign"), 0)))
    own, sums = kept[0].schema.field("own").type, pa.list_(pa.float64())
    kinds = {"least": pa.float64()} | dict.fromkeys(("heavy", "times", "ids", "counts"), pa.binary())
    part_of = None
    ids, counts, sign = np.concatenate(ids), np.concatenate(counts), np.repeat(np.array(signs, np.int8), terms)
    weights = np.zeros(len(ids))
    for r, some in enumerate(ranges(ids)):
        order = some[np.argsort(ids[some])]
        first = starts(ids[order])
        if not len(first):
            continue
        run, kind, count = np.diff(np.append(first, len(order))), sign[order], counts[order].astype(np.int64)
        added = np.add.reduceat((kind == ADDED).astype(np.int64), first)
        more = added - np.add.reduceat((kind == GONE).astype(np.int64), first)
        earlier = np.add.reduceat(np.where(kind == STORED, count, 0), first)
        df = earlier + more
        if tell:
            names, now, heavy, changed = ids[order][first], (earlier > 0) & (df > 0), added > part, more != 0
            least = (idf(n, df[now]) / idf(before, earlier[now])).min() if now.any() else None
            told = (least, names[heavy].tobytes(), added[heavy].tobytes(), names[changed].tobytes(), _packed(more[changed]).tobytes())
            yield pa.RecordBatch.from_pydict({"task": pa.array([-1], pa.int32()), "number": pa.array([r], pa.int32()), "own": pa.nulls(1, own), "sums": pa.nulls(1, sums)}
                                             | {c: pa.array([x], kind) for x, (c, kind) in zip(told, kinds.items(), strict=True)})
        mine = np.flatnonzero(kind > 0)
        weights[order[mine]] = (tf(count[mine]) * idf(n, np.repeat(df, run)[mine])) ** 2
    upto = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[s.astype(np.int64) for s in sizes]]))])
    mine = weights if (sign > 0).all() else weights[sign > 0]
    per_row = np.split(_run_sums(mine, upto), np.cumsum([len(s) for s in sizes])[:-1]) if sizes else []
    del ids, counts, sign, weights, mine
    task, number = (pa.concat_arrays([k.column(c) for k in kept]) for c in ("task", "number"))
    yield pa.RecordBatch.from_pydict({"task": task, "number": number, "own": pa.concat_arrays([k.column("own") for k in kept]), "sums": pa.array(per_row, sums)}
                                     | {c: pa.nulls(len(task), kind) for c, kind in kinds.items()})
    _give_back()


def lengths(table: pa.Table) -> pa.Table:
    """(keys, length) of the rows of a batch that have terms, from what its buckets gave."""
    sums = table.column("sums").combine_chunks()
    total = sums.values.to_numpy().reshape(len(sums), -1).sum(axis=0) if len(sums) else np.zeros(0)
    own = pa.concat_arrays(table.column("own").chunks).flatten()  # of bucket 0 only
    mask = pa.array(total > 0)
    names = [f.name for f in own.type]
    return pa.table([*[x.filter(mask) for x in own.flatten()], pa.array(np.sqrt(total[total > 0]))], [*names, "length"])


def _run_sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at `upto`, 0 for empty runs."""
    out = np.zeros(len(upto) - 1)
    full = np.flatnonzero(np.diff(upto))
    if len(full):
        out[full] = np.add.reduceat(values, upto[:-1][full])
    return out


class Known:
    """Numbers of terms that are asked for, in order."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.seen = np.unique(ids), np.zeros(1 << 20, bool)
        self.seen[self.ids & (len(self.seen) - 1)] = True  # leaves out most others at little cost

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers are known, and their places."""
        some = np.flatnonzero(self.seen[ids & (len(self.seen) - 1)])
        place = np.minimum(np.searchsorted(self.ids, ids[some]), max(len(self.ids) - 1, 0))
        good = self.ids[place] == ids[some] if len(self.ids) else np.zeros(len(some), bool)
        return some[good], place[good]

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        out[self.places(ids)[0]] = True
        return out


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def found(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    """(keys, places of the asked terms that a row has, how often each occurs) of rows of words that have any."""
    for batch in _slices(batches):
        ids, counts, sizes = counted_ids(batch.column("words"))
        some, place = known.places(ids)
        each = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        mask = pa.array(each > 0)
        arrays = [batch.column(i).filter(mask) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*arrays, _listed(place, each[each > 0]), _listed(counts[some], each[each > 0])], [*batch.schema.names[:-1], "at", "counts"])


class Asked:
    """Weights of the terms of some queries: for each place of a term the queries that have it."""

    def __init__(self, name: str, keys: pa.Array, query: np.ndarray, place: np.ndarray, weight: np.ndarray, terms: int) -> None:
        order = np.argsort(place, kind="stable")
        self.name, self.keys, self.query, self.weight = name, keys, query[order], weight[order]
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=terms))])

    def dots(self, rows: int, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Products of rows with all queries, from the rows' terms."""
        times = self.upto[place + 1] - self.upto[place]
        ends = np.cumsum(times)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.upto[place] - ends + times, times)
        cell = np.repeat(row * len(self.keys), times) + self.query[at]
        return np.bincount(cell, np.repeat(weight, times) * self.weight[at], rows * len(self.keys)).reshape(rows, -1)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, terms, counts) of rows of words."""
    for batch in _slices(batches):
        ids, counts, sizes = counted_ids(batch.column("words"))
        upto = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        lists = [pa.ListArray.from_arrays(upto, pa.array(x, pa.int64())) for x in (ids, counts)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], [*batch.schema.names[:-1], "terms", "counts"])


def numbered(query: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct keys of queries, null included, and which of them each row has."""
    codes = pa.chunked_array(query.chunks, query.type).combine_chunks().dictionary_encode("encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return codes.dictionary, codes.indices.to_numpy().astype(np.int64)


def weighed(name: str, query: pa.ChunkedArray, place: np.ndarray, counts: np.ndarray, df: np.ndarray, n: int) -> Asked:
    """Weights of queries of unit length. Terms that no row has count in no query."""
    keys, number = numbered(query)
    good = df[place] > 0
    w = tf(counts) * idf(n, df[place]) * good
    size = np.sqrt(np.bincount(number, w * w, len(keys)))
    weight = w[good] / size[number[good]] * idf(n, df[place[good]])
    return Asked(name, keys, number[good], place[good], weight, len(df))


#: Products that are made together; scores are compared at 9 digits, so thresholds leave that much room.
CELLS, ROOM = 1 << 18, 2e-9


def best(batches: Iterator[pa.RecordBatch], asked: Asked, top_k: int) -> Iterator[pa.RecordBatch]:
    """(query, keys, score) of rows (keys, length, at, counts) that can be among the best of a query: none that a task has
    seen `top_k` better rows of."""
    step = max(1, CELLS // max(1, len(asked.keys)))
    top = np.zeros((top_k, len(asked.keys)))
    for batch in batches:
        at, counts = batch.column("at"), batch.column("counts")
        upto = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
        place, weight = at.flatten().to_numpy(), tf(counts.flatten().to_numpy())
        length = batch.column("length").to_numpy()
        rows, queries, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a in range(0, len(at), step):
            b = min(len(at), a + step)
            x, y = upto[a], upto[b]
            row = np.repeat(np.arange(b - a), np.diff(upto[a : b + 1]))
            score = asked.dots(b - a, row, place[x:y], weight[x:y]) / length[a:b, None]
            top = np.partition(np.concatenate([top, score]), -top_k, axis=0)[-top_k:]
            i, q = np.nonzero((score > 0) & (score >= top[0] - ROOM))
            rows.append(i + a), queries.append(q), scores.append(score[i, q])
        keys = [batch.column(i).take(pa.array(np.concatenate(rows))) for i in range(batch.num_columns - 3)]
        yield pa.RecordBatch.from_arrays([asked.keys.take(pa.array(np.concatenate(queries))), *keys, pa.array(np.concatenate(scores))], [asked.name, *batch.schema.names[:-3], "score"])


def dealt_postings(batches: Iterator[pa.RecordBatch], labels: np.ndarray, heavy: Known, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Postings of rows (keys, length, hash, words) by bucket: (its label, own, lengths, how many terms each row has there,
    these, how often each occurs). A heavy term goes to as many buckets, from its own on, as it has parts."""
    buckets = len(labels)
    for batch in _slices(batches):
        ids, counts, sizes = counted_ids(batch.column("words"))
        bucket, row = bucket_of(ids, buckets), np.repeat(np.arange(len(sizes)), sizes)
        some, place = heavy.places(ids)
        part = batch.column("hash").to_numpy()[row[some]] % parts[place] if len(some) else 0
        bucket[some] = (bucket[some] + part) % buckets
        order = np.argsort(bucket, kind="stable")
        each = np.bincount(bucket.astype(np.int64) * len(sizes) + row, minlength=buckets * len(sizes)).reshape(buckets, -1)
        cuts, full = np.cumsum(each.sum(axis=1))[:-1], each > 0
        at = pa.array(np.nonzero(full)[1])
        upto = np.concatenate([[0], np.cumsum(full.sum(axis=1))])
        keys = pa.StructArray.from_arrays([c.take(at) for c in batch.columns[:-3]], batch.schema.names[:-3])
        lists = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), x) for x in (keys, batch.column("length").take(at))]
        yield pa.RecordBatch.from_arrays([
            pa.array(labels), *lists, _binary([_packed(x[y]) for x, y in zip(each, full, strict=True)]),
            _binary(np.split(ids[order], cuts)), _binary([_packed(x) for x in np.split(counts[order], cuts)]),
        ], ["bucket", "own", "lengths", "sizes", "ids", "counts"])


def blocks(batches: Iterator[pa.RecordBatch], labels: np.ndarray, stored: int, size: int) -> Iterator[pa.RecordBatch]:
    """Postings of a bucket in blocks of `size`, the largest weights of a term first: (bucket among those stored, term, part,
    block, top, size, entries). Weights have 24 bits."""
    own, length, sizes, ids, counts, number, buckets = [], [], [], [], [], 0, len(labels)
    for part_of in batches:
        number = int(np.flatnonzero(labels == part_of.column("bucket")[0].as_py())[0])
        own.append(part_of.column("own").flatten()), length.append(part_of.column("lengths").flatten().to_numpy().copy())
        for i, rows in enumerate(part_of.column("own").value_lengths().to_pylist()):
            ids.append(np.frombuffer(part_of.column("ids")[i].as_buffer(), np.int64))
            counts.append(_unpacked(part_of.column("counts")[i], len(ids[-1])))
            sizes.append(_unpacked(part_of.column("sizes")[i], rows))
    part_of = None
    own, length, ids, counts, sizes = pa.concat_arrays(own), *map(np.concatenate, (length, ids, counts, sizes))
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    for some in ranges(ids):
        some = some[np.argsort(ids[some])]
        weight = (tf(counts[some]) / length[row[some]]).astype(np.float32)
        run = np.cumsum(np.concatenate([[0], ids[some][1:] != ids[some][:-1]])) if len(some) else np.zeros(0, np.int64)
        # by run, then by weight from the largest on, which the bits of positive numbers follow
        order = np.argsort((run.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - weight.view(np.uint32)))
        some, weight, run = some[order], weight[order], run[order]
        place = np.arange(len(run)) - np.repeat(starts(run), np.diff(np.append(starts(run), len(run))))
        first = np.flatnonzero(place % size == 0)
        term = ids[some[first]]
        base = bucket_of(term, buckets).astype(np.int64)
        entries = pa.StructArray.from_arrays([*[c.take(pa.array(row[some])) for c in own.flatten()], pa.array(weight)], [*[f.name for f in own.type], "weight"])
        upto = pa.array(np.append(first, len(some)), pa.int32())
        if len(first):
            yield pa.RecordBatch.from_arrays([
                pa.array((base % stored).astype(np.int32)), pa.array(term), pa.array(((number - base) % buckets).astype(np.int32)), pa.array((place[first] // size).astype(np.int32)),
                pa.array(np.maximum.reduceat(weight, first)), pa.array(np.diff(np.append(first, len(some)))), pa.ListArray.from_arrays(upto, entries),
            ], ["bucket", "term", "part", "block", "top", "size", "entries"])
    _give_back()
