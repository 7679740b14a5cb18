"""Vectorised words, shingles and hashes over Arrow text columns.

A text column arrives as one byte buffer with offsets; every step below works on whole
slices of that buffer, so no Python loop touches a character or a word. Null text counts
as empty. Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INV)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def column(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    size = 8 if wide else 4
    offsets = np.frombuffer(at, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * size).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(buf: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole texts of about ``most`` bytes; a longer text comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def _prefix(b: np.ndarray) -> np.ndarray:
    up, _ = _powers_to(len(b) + 1)
    out = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[:len(b)], out=out[1:])
    return out


def word_bounds(b: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and the number of words before each text; ``between`` marks the bytes that part them."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash per word, number of words before each text), A-Z lower-cased."""
    starts, ends, first = word_bounds(b, offsets)
    return hashes(b, starts, ends), first


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run of bytes, A-Z lower-cased."""
    total = _prefix(LOWER[b])
    _, down = _powers_to(len(b) + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[d] + 0..counts[d]-1 of every text d, and where each text begins among them."""
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], counts), bounds


def word_shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, bounds per text); a text of fewer words is one shingle, one without words none."""
    words = np.diff(first)
    at, bounds = _spread(first[:-1], np.where(words >= k, words - k + 1, (words > 0).astype(np.int64)))
    long = np.repeat(words, np.diff(bounds))
    out = h[at] if len(at) else np.zeros(0, U)
    for j in range(1, k):
        step = mix(out * U(0xD6E8FEB86659FD93) + h[np.minimum(at + j, len(h) - 1)] + U(j)) if len(at) else out
        out = np.where(j < long, step, out)
    return out, bounds


def byte_shingles(b: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the run of up to ``width`` bytes that ends at each byte, bounds per text); a text has as many as bytes."""
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    end = np.arange(1, len(b) + 1)
    at = np.maximum(end - width, begin)
    total = _prefix(b)
    _, down = _powers_to(len(b) + 1)
    return mix((total[end] - total[at]) * down[at] + (end - at).astype(U)), offsets


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and their bounds."""
    sets = [np.unique(values[a:z]) for a, z in zip(bounds[:-1], bounds[1:])]
    out = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, U)), out
