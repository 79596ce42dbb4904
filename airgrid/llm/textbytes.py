"""Vectorised words, lines and shingles over the UTF-8 bytes of an Arrow batch (numpy only)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U = np.uint64
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _table(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U) + U(seed) * U(1000)) * _GOLD)


_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 2)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = U(1)
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


#: Bytes that separate words for ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a-z and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column; null counts as empty."""
    return batch.column(name).cast(pa.large_string()).fill_null("")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """``run``, giving the memory that Arrow keeps for later batches back when a task ends: workers outlive their tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes (one text at least): first row, end row, bytes, offsets from 0."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row, its first word; one more at the end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of ``inside`` bytes within each row."""
    rows = len(offsets) - 1
    mask = inside[data]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    if len(mask):
        before[1:], after[:-1] = mask[:-1], mask[1:]
        before[offsets[:-1][offsets[:-1] < len(mask)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(row, start, end, np.searchsorted(row, np.arange(rows + 1)))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte runs [start, end)."""
    up, down = _power(len(data) + 1)
    table = _table(seed)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((table if fold is None else table[fold])[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ ((end - start).astype(U) * _GOLD))


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and the index of each one's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(n, U(int(k) * int(_GOLD) & (2**64 - 1)))
    for j in range(k):
        total = total * U(0xFF51AFD7ED558CCD) + h[j : j + n]
        total ^= total >> U(32)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(total[at]), at


def counted(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, rows).astype(np.int64)
