"""Word and window hashes of whole Arrow batches, as numpy arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial in its bytes
(each byte stands for a random 64-bit number) modulo 2**64; a window's hash is a polynomial in its
words' hashes. Everything is computed for a slab of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLAB_BYTES = 1 << 21

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _pow(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, SLAB_BYTES), base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers


@dataclass
class Words:
    """Words of a slab: byte offsets into ``data``, hashes, and per document its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, and one past the last

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k consecutive words of one document, and per document its
        first window (and one past the last)."""
        n = self.counts()
        m = np.maximum(n - (k - 1), 0)
        bounds = np.concatenate([[0], np.cumsum(m)])
        if not bounds[-1]:
            return np.zeros(0, U), bounds
        h = self.hash if not which else mix(self.hash + U(_STEP[1]))
        total = len(h) - (k - 1)
        acc = h[:total].copy()
        step = 1
        for j in range(1, k):
            step = step * _STEP[which] % (1 << 64)
            acc += h[j : j + total] * U(step)
        inside = np.ones(len(h), bool)  # windows that stay in their document
        ends = self.first[1:]
        for j in range(1, k):
            inside[np.maximum(ends - j, self.first[:-1])[n > 0]] = False
        return mix(acc[inside[:total]]), bounds


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string array; null texts have none. ``lower`` maps A-Z to a-z first."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and n else np.zeros(0, np.uint8)
    offs = offs - offs[0] if n else np.zeros(1, np.int64)
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(0, U), np.zeros(n + 1, np.int64))
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(start):
        power, inverse = _pow(len(data))
        sums = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], start)
        hashes = mix(sums * inverse[start] + (end - start).astype(U) * U(_STEP[0]))
    else:
        hashes = np.zeros(0, U)
    return Words(data, start, end, hashes, np.searchsorted(start, offs))


def slabs(batch: pa.RecordBatch | pa.Table, text: str = "text", most: int = SLAB_BYTES) -> Iterator[pa.Table]:
    """Pieces of consecutive rows with about ``most`` bytes of text each; a longer text stands alone."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if not table.num_rows:
        return
    table = table.combine_chunks()
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy(), np.int64))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield table.slice(at, to - at)
        at = to


def text_of(table: pa.Table, column: str = "text") -> pa.Array:
    """The column as one array."""
    chunks = table[column].combine_chunks()
    return chunks if isinstance(chunks, pa.Array) else pa.concat_arrays(chunks.chunks)
