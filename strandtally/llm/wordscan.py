"""Vectorised word scanning of Arrow text columns.

All operators here cut words the same way: maximal runs of characters other
than space and U+0009 to U+000D. The scan works on the UTF-8 buffer of an Arrow
array, so no Python string is made per word; words and lines are known by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``most_bytes`` of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    piece = np.cumsum(sizes, dtype=np.int64) // most_bytes
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    inside: np.ndarray  # byte belongs to a word
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # words of text i are first[i]:first[i + 1]
    doc: np.ndarray  # text of each word

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, self.inside)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def scan(texts: pa.Array, lower: bool) -> Words:
    data, offsets = raw_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = ~SEPARATOR[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[full] = inside[full]
        full = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[full] = inside[full]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, inside, starts, ends, first, doc)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for ascending spans; bytes outside all spans must not be ``inside``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    value = _BYTE[data]
    value *= up
    value *= inside
    return mix(np.add.reduceat(value, starts) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def windows(h: np.ndarray, first: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within a text, and the place of each run's first word."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, size):  # a run may not begin in the last size - 1 words of a text
        at = first[1:] - back
        ok[at[at >= first[:-1]]] = False
    at = np.flatnonzero(ok)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = (out ^ h[at + k]) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k + 1)
        out ^= out >> np.uint64(32)
    return mix(out), at


def per_doc(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made distinct between texts, so that one sort serves all of them."""
    return mix(h + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
