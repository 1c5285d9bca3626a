"""Word shingles of whole texts, by array operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is handled alone and whole.
CHUNK = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def spread(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def random_odd(first: int, n: int) -> np.ndarray:
    """Fixed pseudo-random odd coefficients number ``first`` to ``first + n - 1``."""
    with np.errstate(over="ignore"):
        return spread(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_COEFFICIENTS = random_odd(0, 256)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, joined, and where each text begins (with the end as last); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and len(starts) else np.zeros(0, dtype=np.uint8)
    return (data[starts[0] : starts[-1]], starts - starts[0]) if len(starts) else (data[:0], np.zeros(1, dtype=np.int64))


def pieces(starts: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word (A-Z in lower case) and which text it is in."""
    global _COEFFICIENTS
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    first = np.flatnonzero(~space & (before | edge[:n]))
    if not len(first):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lead = first[0]
    place = np.arange(lead, n) - np.repeat(first, np.diff(np.append(first, n)))
    gap = space[lead:]
    place[gap] = 0
    longest = int(place.max()) + 1
    if longest > len(_COEFFICIENTS):
        _COEFFICIENTS = random_odd(0, 2 * longest)
    value = (_LOWER[data[lead:]].astype(np.uint64) + np.uint64(1)) * _COEFFICIENTS[place]
    value[gap] = 0
    hashes = np.add.reduceat(value, first - lead)
    return spread(hashes), np.searchsorted(starts, first, side="right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the k-word shingles of each text, in order, and where each text's begin (with the end as last).

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    count = np.bincount(text, minlength=n_texts)
    p = random_odd(1 << 20, k + 1)
    m = max(0, len(words) - k + 1)
    whole = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        whole += words[j : j + m] * p[j]
    inside = text[:m] == text[k - 1 : k - 1 + m]
    per_text = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(per_text)])
    out = np.empty(starts[-1], dtype=np.uint64)
    long = np.repeat(count >= k, per_text)
    out[long] = spread(whole[inside])
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    for size in range(1, k):
        own = np.flatnonzero(count == size)
        if len(own):
            value = np.full(len(own), size, dtype=np.uint64) * p[k]
            for j in range(size):
                value += words[at[own] + j] * p[j]
            out[starts[own]] = spread(value)
    return out, starts


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    data, starts = packed(column)
    for a, b in pieces(starts):
        words, text = word_hashes(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        hashes, at = shingle_hashes(words, text, b - a, k)
        for i in range(b - a):
            yield np.unique(hashes[at[i] : at[i + 1]])
