"""Whole Arrow batches of text as flat numpy arrays: words, hashes, per-document slices.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z.
Null texts count as empty. Nothing here looks at a prefix of a text: a batch is
cut into pieces of whole documents, and a document longer than a piece is a
piece of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _libc = None

PIECE_BYTES, LONG = 1 << 20, 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_R = np.uint64(0x9E3779B97F4A7C15 | 3)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # keeps the first k bytes of a block
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """r^0 .. r^(n-1) modulo 2^64, kept between the calls of a task."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        m = max(n, PIECE_BYTES + 1)
        out = np.empty(m, np.uint64)
        out[0], k = 1, 1
        step = _R_INV if inverse else _R
        while k < m:  # doubling: out[k:2k] = out[:k] * step^k
            take = min(k, m - k)
            out[k : k + take] = out[:take] * np.uint64(pow(int(step), k, 1 << 64))
            k += take
        _powers[inverse] = have = out
    return have[:n]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows (one more than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of whole rows with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, done = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])
    if done > 4 * most:
        release()


def release() -> None:
    """Gives freed memory back to the system: workers live long, and executors count it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, where a worker that then waits for its next task keeps no memory of this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _powers.clear()
        release()

    return run


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    return np.ndarray((len(data) + 1,), "<u8", np.r_[data, np.zeros(8, np.uint8)], 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; those of more than LONG bytes by a digest each."""
    size = ends - starts
    at = blocks(data)
    h = mix(at[starts] & _LOW[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _M2
    more = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(more):
        h[more] = mix(h[more] ^ (at[starts[more] + done] & _LOW[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and the index of each row's first word (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, word_hashes(LOWER[data] if fold else data, starts, ends), np.searchsorted(starts, offsets)


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of eight bytes or more that depend on their content alone; ``p`` from block_prefix."""
    return mix((p[ends - 7] - p[starts]) * powers(len(p), True)[starts] + (ends - starts).astype(np.uint64) * _M2)


def block_prefix(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum over i <= k < j of a mix of the eight bytes from k on, times r^k."""
    x = blocks(data)[:-1] * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(x * powers(len(data)), out=p[1:])
    return p


def word_hash(word: str) -> int:
    """The hash that words() gives for one word."""
    d = np.frombuffer(word.encode(), np.uint8)
    return int(words(d, np.array([0, len(d)]))[2][0])


_INDEX = np.uint64((1 << 24) - 1)


def order_of(keys: np.ndarray) -> np.ndarray:
    """What argsort gives for hashes, by one sort of their first 40 bits with places; the few that are equal there and not in all are put right."""
    if len(keys) > int(_INDEX):
        return np.argsort(keys, kind="stable")
    both = np.sort((keys & ~_INDEX) | np.arange(len(keys), dtype=np.uint64))
    out = (both & _INDEX).astype(np.int64)
    got = keys[out]
    wrong = np.flatnonzero(got[1:] < got[:-1])
    if len(wrong):
        run = np.cumsum(np.r_[False, (both[1:] ^ both[:-1]) > _INDEX])
        at = np.flatnonzero(np.isin(run, run[wrong]))
        out[at] = out[at][np.lexsort((out[at], got[at], run[at]))]
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Counts:
    """Counts of 64-bit keys in bounded memory: sorted runs that merge when they are as large as what is pending.

    add() gives nothing while fewer than ``limit`` distinct keys are held; beyond it
    flush() hands them out, and whoever sums the parts gets the same totals.
    """

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.keys, self.n, self.pending, self.waiting = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.pending.append(keys)
            self.waiting += len(keys)
            if self.waiting > max(1_000_000, len(self.keys)):
                self.compact()

    def compact(self) -> None:
        if self.pending:
            new = np.sort(np.concatenate(self.pending))
            first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
            self.pending, self.waiting = [], 0
            new, n = new[first], np.diff(np.r_[first, len(new)])
            at = np.searchsorted(self.keys, new)
            there = np.flatnonzero(at < len(self.keys))
            there = there[self.keys[at[there]] == new[there]]
            self.n[at[there]] += n[there]
            fresh = np.ones(len(new), bool)
            fresh[there] = False
            self.keys, self.n = np.insert(self.keys, at[fresh], new[fresh]), np.insert(self.n, at[fresh], n[fresh])

    def full(self) -> bool:
        return len(self.keys) >= self.limit

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        self.compact()
        out = self.keys, self.n
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in sorted_keys, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)
