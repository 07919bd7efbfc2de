"""Words, hashes and minimizers over the UTF-8 bytes of Arrow string columns, as numpy arrays.

A *chunk* is a run of whole documents: its bytes and the offsets of its documents. Nulls are empty texts.
All hashes are 64 bits wide and depend on content alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each value (splitmix64's finalizer)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def class_table(low_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that is outside of the given ranges (both ends are in a range)."""
    table = np.ones(256, bool)
    for a, b in low_ranges:
        table[a : b + 1] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = class_table([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
PLAIN = class_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of documents of about size bytes; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, none across documents; and the first word's index of each document, with the number of words at the end."""
    m = table[data]
    start, end = m.copy(), m.copy()
    if len(m):
        start[1:] &= ~m[:-1]
        end[:-1] &= ~m[1:]
        full = offsets[:-1] < offsets[1:]
        at, stop = offsets[:-1][full], offsets[1:][full] - 1
        start[at], end[stop] = m[at], m[stop]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and their inverses."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("p", _P), ("i", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["p"][:n], _powers["i"][:n]


class Rolling:
    """Hashes of any byte ranges of a chunk in constant time each."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        p, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * p[:-1], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k bytes."""
        n = max(len(self.sums) - k, 0)
        return mix((self.sums[k : k + n] - self.sums[:n]) * self.inverse[:n] + U64(k))


def word_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words' hashes; whoever calls leaves out those that cross documents."""
    size = max(len(hashes) - n + 1, 0)
    h = hashes[:size].copy()
    for j in range(1, n):
        h = h * U64(_Q) + hashes[j : j + size]
    return mix(h + U64(n))


def within(first: np.ndarray, n: int) -> np.ndarray:
    """For each word of the chunk, whether n words from it on are of its document."""
    inside = np.zeros(int(first[-1]), bool)
    count = np.diff(first)
    edges = np.zeros(int(first[-1]) + 1, np.int32)
    ok = count >= n
    edges[first[:-1][ok]] += 1
    edges[first[1:][ok] - n + 1] -= 1
    inside[:] = np.cumsum(edges[:-1]) > 0
    return inside


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    if len(values) < w:
        return values[:0]
    out, span = values, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive grams, the index of the least (by its high 32 bits; the first of equals)."""
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    return (sliding_min(packed, w) & U64(0xFFFFFFFF)).astype(np.int64)


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags over each document's places."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
