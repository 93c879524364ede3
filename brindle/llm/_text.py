"""Vectorised work on whole texts: Arrow buffers in, NumPy arrays out.

A hash of a run of units is a polynomial in an odd base modulo 2**64, so that one running sum gives the hash of any run,
wherever it stands. Such polynomials can be made to collide by construction from 1,024 units on (a word that follows the
Thue-Morse sequence, and its complement), so single words and pieces of LONG units or more are hashed with xxh3 instead. Texts are taken in slices of a few MB; memory follows the slice, or the longest text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
SLICE = 1 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: An odd random number for each byte; for lower-casing, A-Z share those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Hashes of runs of one sequence of numbers."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


#: Units from which on a run is hashed by itself.
LONG = 512


def apart(hashes: np.ndarray, units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """hashes of the runs of units, those of LONG units or more replaced (in place) by xxh3 of what the runs hold."""
    for k in np.flatnonzero(end - start >= LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(units[start[k] : end[k]].tobytes())
    return hashes


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back: workers are kept, and the next operator's share of the executor is no larger for this one."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):  # glibc's
        _libc.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about limit bytes of text, or one text that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offs = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    release()


def _word_pieces(raw: np.ndarray, offs: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """Cuts at white space or at a text's start."""
    cuts, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + piece)
        if to < len(raw):
            stop = offs[np.searchsorted(offs, to)] if to <= offs[-1] else len(raw)
            while to < stop:
                gap = np.flatnonzero(_SPACE[raw[to : min(stop, to + 65536)]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(int(stop), to + 65536)
        cuts.append((at, int(to)))
        at = int(to)
    return cuts


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts: byte spans, hashes, and each text's first word."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False, hashes: bool = True):
        starts, ends, hashed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        table = _BYTE_LOWER if lower else _BYTE
        for a, b in _word_pieces(raw, offs, SLICE):
            part = raw[a:b]
            word = ~_SPACE[part]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offs[np.searchsorted(offs, a) : np.searchsorted(offs, b)] - a
            first[inner] |= word[inner]
            inner = inner[inner > 0]
            last[inner - 1] |= word[inner - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if hashes:
                hashed.append(apart(Runs(table[part]).hash(s, e), table[part], s, e))
            starts.append(s + a)
            ends.append(e + a)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.hash = np.concatenate(hashed)
        self.offs = np.searchsorted(self.start, offs)


def sliding_first_min(keys: np.ndarray, width: int) -> np.ndarray:
    """For every window of width keys, the place of the first of those whose upper 32 bits are smallest."""
    packed = (keys >> U64(32) << U64(32)) | np.arange(len(keys), dtype=U64)
    n = len(packed) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = 1
    while size * 2 <= width:
        packed = np.minimum(packed[:-size], packed[size:])
        size *= 2
    return (np.minimum(packed[:n], packed[width - size : width - size + n]) & U64(0xFFFFFFFF)).astype(np.int64)
