"""Vectorised text scanning over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which is the
UTF-8 view of ``[^\\x20\\x09-\\x0D]+``.  Everything works on the concatenated
bytes of a slice of rows, so the cost is a few array passes and no Python
object per word is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Gives memory that is free back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def _constants(seed: int) -> tuple[np.ndarray, int]:
    """A byte table of random words and a random odd multiplier."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 2**64, size=256, dtype=U64, endpoint=False), int(rng.integers(1, 2**63)) | 1


_HASHES = {lane: _constants(0x5EED + lane) for lane in (0, 1)}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Texts:
    """Bytes of some rows, and their words; rows[k]:rows[k+1] delimits row k."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[k]:first[k+1] are the words of row k

    @property
    def n_rows(self) -> int:
        return len(self.rows) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.n_rows), self.n_words)

    def byte_sums(self, table: np.ndarray) -> np.ndarray:
        """Per row the sum over its bytes of table[byte]."""
        total = np.concatenate(([0], np.cumsum(table[self.data], dtype=np.int64)))
        return total[self.rows[1:]] - total[self.rows[:-1]]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunk at all, or too many bytes for one
            column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def scan(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Texts:
    data, rows = column_bytes(column)
    return scan_bytes(data, rows, lower)


def scan_bytes(data: np.ndarray, rows: np.ndarray, lower: bool = False) -> Texts:
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)  # a row begins here
    edge[rows] = True
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1] | edge[1:n]
    stop = word.copy()
    stop[:-1] &= space[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return Texts(data, rows, starts, ends, np.searchsorted(starts, rows))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    n = len(column)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(column), 0)
    sizes = np.asarray(sizes.to_numpy(zero_copy_only=False) if isinstance(sizes, pa.Array) else sizes.to_numpy(), dtype=np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield at, end
        at = end


def _parts(sizes: np.ndarray, limit: int = 1 << 18) -> Iterator[slice]:
    """Runs of spans of about ``limit`` bytes, so that what is made per byte stays small and in cache."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield slice(at, end)
        at = end


def _bytes_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of all spans: place in the span and in the data; and where each span begins among them."""
    heads = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    return within, within + np.repeat(starts, sizes), heads


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]]."""
    table, odd = _HASHES[lane]
    size = ends - starts
    out = np.zeros(len(starts), U64)
    full = np.flatnonzero(size > 0)
    if len(full):
        power = np.full(int(size.max()), odd, U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        for part in _parts(size[full]):
            which = full[part]
            within, place, heads = _bytes_of(starts[which], size[which])
            values = table[data[place]]
            values *= power[within]
            out[which] = np.add.reduceat(values, heads)
    return mix64(out + size.astype(U64) * U64(0x9E3779B97F4A7C15))


def word_hash(t: Texts, lane: int = 0) -> np.ndarray:
    return span_hash(t.data, t.starts, t.ends, lane)


def windows(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words within one row, and their rows."""
    count = np.maximum(t.n_words - size + 1, 0)
    heads = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.arange(int(count.sum())) - np.repeat(heads - t.first[:-1], count)
    return at, np.repeat(np.arange(t.n_rows), count)


def window_hash(words: np.ndarray, at: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of the word sequence of each window that begins at ``at``."""
    _, odd = _HASHES[lane]
    out = np.zeros(len(at), U64)
    for j in range(size):
        out = out * U64(odd) + words[at + j]
    return mix64(out)


def packed_words(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in which each word is followed by one space, and the words' places there."""
    size = t.ends - t.starts
    place = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(int(place[-1]), 0x20, np.uint8)
    for part in _parts(size):
        within, source, _ = _bytes_of(t.starts[part], size[part])
        out[within + np.repeat(place[:-1][part], size[part])] = t.data[source]
    return out, place


# XXH64 primes (fixed values of the public algorithm)
_P1, _P2, _P3, _P4, _P5 = (
    U64(0x9E3779B185EBCA87),
    U64(0xC2B2AE3D27D4EB4F),
    U64(0x165667B19E3779F9),
    U64(0x85EBCA77C2B2AE63),
    U64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i]:starts[i]+sizes[i]] for all i at once."""
    n = len(starts)
    if not n:
        return np.zeros(0, U64)
    buf = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(buf) - 7,), "<u8", buffer=buf.data, strides=(1,))
    halves = np.ndarray((len(buf) - 3,), "<u4", buffer=buf.data, strides=(1,))
    at = starts.astype(np.int64).copy()
    left = sizes.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        s = U64(seed)
        acc = np.full(n, s + _P5, U64)
        big = np.flatnonzero(left >= 32)
        if len(big):
            a = [np.full(len(big), v, U64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            live = np.arange(len(big))
            while len(live):
                rows = big[live]
                for k in range(4):
                    a[k][live] = _round(a[k][live], lanes[at[rows] + 8 * k])
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            h = _rotl(a[0], 1) + _rotl(a[1], 7) + _rotl(a[2], 12) + _rotl(a[3], 18)
            for k in range(4):
                h = (h ^ _round(np.zeros(len(big), U64), a[k])) * _P1 + _P4
            acc[big] = h
        acc += sizes.astype(U64)
        live = np.flatnonzero(left >= 8)
        while len(live):
            acc[live] = _rotl(acc[live] ^ _round(np.zeros(len(live), U64), lanes[at[live]]), 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
            live = live[left[live] >= 8]
        live = np.flatnonzero(left >= 4)
        if len(live):
            acc[live] = _rotl(acc[live] ^ (halves[at[live]].astype(U64) * _P1), 23) * _P2 + _P3
            at[live] += 4
            left[live] -= 4
        live = np.flatnonzero(left > 0)
        while len(live):
            acc[live] = _rotl(acc[live] ^ (buf[at[live]].astype(U64) * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
            live = live[left[live] > 0]
        acc ^= acc >> U64(33)
        acc *= _P2
        acc ^= acc >> U64(29)
        acc *= _P3
        acc ^= acc >> U64(32)
    return acc
