"""Word hashes for whole Arrow batches of text, with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur inside another
character. Each word gets a 64-bit polynomial hash of its bytes, so equal words agree in every task and run.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK_BYTES = 2 << 20
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64)
                    for b in (self.base, self.inverse)
                )
        return self.up, self.down


_POWERS = {seed: _Powers(base) for seed, base in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))}


class Words:
    """The words of a column of texts. Row i has the words `first[i]` to `first[i + 1]`; nulls have none."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        if texts.null_count:
            texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        data = data[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        self.bytes, self.bounds = (LOWER[data] if lower else data), bounds
        inside = ~SEPARATOR[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, seed: int = 0) -> np.ndarray:
        out, a, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        letters = mix(np.arange(1, 257, dtype=np.uint64), seed + 1)
        with np.errstate(over="ignore"):
            while a < n:
                low = self.starts[a]
                b = max(a + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES, "right")))
                high = self.ends[b - 1]
                up, down = _POWERS[seed].upto(high - low)
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(letters[self.bytes[low:high]] * up[: high - low], out=sums[1:])
                s, e = self.starts[a:b] - low, self.ends[a:b] - low
                out[a:b] = mix((sums[e] - sums[s]) * down[s], seed)
                a = b
        return out

    def windows(self, hashes: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of first words) and hashes of all runs of `size` words inside one row."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        with np.errstate(over="ignore"):
            total = np.zeros(len(at), np.uint64)
            for k in range(size):
                total = total * np.uint64(0x9FB21C651E98DF25) + hashes[at + k]
        return at, mix(total, seed + size)


def give_back() -> None:
    """Return freed memory to the system: a Python worker that waits for its next task shouldn't hold that of the last."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about BLOCK_BYTES of text, so that memory doesn't follow the batch size."""
    try:
        yield from _blocks(batches, column)
    finally:
        give_back()


def _blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        group = np.cumsum(np.diff(bounds.astype(np.int64))) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
