"""Counts of all words, pairs and triples of a corpus, asked for by the slices that hold them.

Texts are packed into slices of about SLICE words, a row of a written table each, so what
a slice holds never changes. A slice sends its distinct words, pairs and places (as in
ngram.spans()) as hashes with their counts, sorted and packed, to owners of ranges of
hashes. An owner adds up, and answers each slice in the order of its question; one slice
of those that hold a place is told to give it out. So each place comes out once, with
five counts that no single shuffle of places could bring together, and its strings travel
only once, in the slice. A frequent word reaches its owner once for each slice, so no key
is hot. Owners take the ranges in ROUNDS parts one after the other, to hold less on disk;
there are as many of them as keep a range near PART hashes.

Words are told apart by 64 bits of hash, pairs and places by 80; within a slice by the words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .places import ROWS, _bytes, _counted, _flushes, _places, _strings

SLICE, PART, ROUNDS, KEYS_A_WORD = 500_000, 2_000_000, 2, 1.5
_SALT = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0x5851F42D4C957F2D)

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim
    _libc = None


def _release() -> None:
    """Gives freed memory back to the system: idle workers live long, and executors count it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, byte planes apart, and bytes; compressed."""
    out = []
    for p in parts:
        if isinstance(p, bytes):
            out += [np.array([0, len(p)], np.int64).tobytes(), p]
        else:
            top = int(p.max()) if len(p) else 0
            wide = max(1, (top.bit_length() + 7) // 8)
            out += [np.array([wide, len(p)], np.int64).tobytes(), np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list:
    raw, out, at = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(raw):
        wide, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        if wide:
            all_ = np.zeros((n, 8), np.uint8)
            all_[:, :wide] = np.frombuffer(raw, np.uint8, wide * n, at).reshape(wide, n).T
            out.append(all_.view("<u8").ravel())
        else:
            out.append(raw[at : at + n])
        at += n * max(wide, 1)
    return out


def sliced(texts: DataFrame) -> DataFrame:
    """slice, words (marks included) and blob (words by number, texts' lengths, the words) of texts (one column, lower-cased, never null), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for words, lengths in _flushes(batches, SLICE):
            known = words.dictionary_encode()
            blob = _pack(known.indices.to_numpy(zero_copy_only=False), lengths, *_bytes(known.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(words) + len(lengths)]), pa.array([blob], pa.binary())], ["slice", "words", "blob"])
            number += 1
            del words, lengths, known, blob
            _release()

    return written(texts.mapInArrow(run, "slice long, words long, blob binary"))


class Slice:
    """The distinct words (all of ``names``), pairs and places of a slice, in order of the words' numbers."""

    def __init__(self, blob: bytes, mark: str):
        ids, lengths, size_of, data = _unpack(blob)
        lengths = lengths.astype(np.int64)
        self.names = pa.concat_arrays([_strings(size_of.astype(np.int64), data), pa.array([mark], pa.large_string())])
        self.none, end, size = len(self.names), len(self.names) + 1, len(self.names) + 2
        ids = np.insert(ids.astype(np.int64), np.cumsum(lengths) - lengths, len(self.names) - 1)
        w2, w1, word = _places(ids, lengths + 1, self.none, end)
        inside = word != end
        w2, w1, word = w2[inside], w1[inside], word[inside]
        pair, self.word, self.n3, pairs = _counted(w2, w1, word, None, size)
        del w2, w1, word, inside, ids
        self.w2, self.w1 = (pairs // size)[pair], (pairs % size)[pair]
        self.pairs, self.last = np.unique(self.w1 * size + self.word, return_inverse=True)
        self.before = np.searchsorted(self.pairs, pairs)[pair]  # of w2 w1; no pair where w2 is none
        self.size, self.hashes = size, None

    def keys(self) -> list[np.ndarray]:
        """Hashes of each word, pair and place."""
        if self.hashes is None:
            self.hashes = np.r_[pd.util.hash_array(self.names.to_numpy(zero_copy_only=False).astype(object), categorize=False), _NONE].astype(np.uint64)
        return self._keys(_SALT)

    def others(self) -> list[np.ndarray]:
        """Second hashes, of 16 bits, after keys()."""
        return [(k >> np.uint64(48)).astype(np.uint16) for k in self._keys(~_SALT)]

    def _keys(self, salt: np.ndarray) -> list[np.ndarray]:
        h = self.hashes
        one, two, three = (_mix(h + s) for s in salt)
        both = _mix(two[self.pairs // self.size] + h[self.pairs % self.size])
        return [one[: self.none], both, _mix(_mix(three[self.w2] + h[self.w1]) + h[self.word])]

    def counts(self) -> list[np.ndarray]:
        sums = lambda at, n: np.bincount(at, weights=self.n3, minlength=n).astype(np.int64)
        return [sums(self.word, self.none), sums(self.last, len(self.pairs)), self.n3]


def _questions(slices: DataFrame, mark: str, parts: int, now: range) -> DataFrame:
    """part, slice, blob: for words, pairs and places the keys in the ranges of ``now`` (as differences, and their second hashes) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(j << 64) // parts for j in [*now, now.stop] if j < parts], np.uint64)  # the last range has no end
        for batch in batches:
            for number, blob in zip(batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                own = Slice(blob.as_py(), mark)
                kinds = []
                for key, more, n in zip(own.keys(), own.others(), own.counts(), strict=True):
                    here = key >= edges[0]
                    if now.stop < parts:
                        here &= key < edges[-1]
                    here = np.flatnonzero(here)
                    here = here[_order(key[here])]
                    key = key[here]
                    kinds.append((key, more[here], n[here], [*np.searchsorted(key, edges).tolist(), len(key)]))
                del own
                rows = []
                for i, j in enumerate(now):
                    cut = [(k, m, n, at[i], at[i + 1]) for k, m, n, at in kinds]
                    if any(a < b for *_, a, b in cut):
                        rows.append((j, _pack(*(x for k, m, n, a, b in cut for x in (np.diff(k[a:b], prepend=np.uint64(0)), m[a:b], n[a:b])))))
                yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["part", "slice", "blob"])
                del kinds, rows, key, more, n, here
                _release()

    return slices.select("slice", "blob").mapInArrow(run, "part int, slice long, blob binary")


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order, by the much faster sort that isn't where no two keys are equal."""
    order = np.argsort(key)
    have = key[order]
    return np.argsort(key, kind="stable") if (have[1:] == have[:-1]).any() else order


def _totals(key: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of ``n`` over rows with its two hashes, and whether it is the one that leads these."""
    order = np.argsort(key)
    k, m = key[order], more[order]
    if ((k[1:] == k[:-1]) & (m[1:] != m[:-1])).any():
        order = np.lexsort((more, key))
        k, m = key[order], more[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.zeros(0, np.int64)
    total, leads = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    if len(k):
        total[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.r_[first, len(k)]))
        leads[order[first]] = True
    return total, leads


def _answers(asked: DataFrame, owners: int) -> DataFrame:
    """slice, part, blob (totals in the order of the question; of places doubled, and one more where this slice gives it out) and, once for a part, its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts = [], []
        for batch in batches:
            for part, number, blob in zip(batch.column("part").to_pylist(), batch.column("slice").to_pylist(), batch.column("blob"), strict=True):
                k1, m1, n1, k2, m2, n2, k3, m3, n3 = _unpack(blob.as_py())
                heads.append((part, number, [len(k1), len(k2), len(k3)]))
                parts.append([(np.cumsum(k, dtype=np.uint64), m.astype(np.uint16), n.astype(np.int64)) for k, m, n in ((k1, m1, n1), (k2, m2, n2), (k3, m3, n3))])
        if not heads:
            return
        got, words = [], 0
        for kind in range(3):
            total, leads = _totals(*(np.concatenate(v) for v in zip(*(p.pop(0) for p in parts), strict=True)))
            got.append(total * 2 + leads if kind == 2 else total)
            words += int(leads.sum()) if kind == 0 else 0
        at = [0, 0, 0]
        for part, number, n in heads:
            blob = _pack(*(g[a : a + x] for g, a, x in zip(got, at, n, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.array([words])], ["slice", "part", "blob", "words"])
            at, words = [a + x for a, x in zip(at, n, strict=True)], 0
        del got, parts, heads
        _release()

    return asked.repartitionById(owners, F.col("part") % owners).mapInArrow(run, "slice long, part int, blob binary, words long")


_COUNTS = ("c1", "c2", "c3", "h1", "h2")
Value = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]


def _given(own: Slice, blobs: list[bytes], value: Value | None) -> Iterator[pa.RecordBatch]:
    counts = []
    for key, n in zip(own.keys(), zip(*map(_unpack, blobs), strict=True), strict=True):
        each = np.empty(len(key), np.int64)
        each[_order(key)] = np.concatenate(n).astype(np.int64)
        counts.append(each)
    one, two, three = np.r_[counts[0], 0], np.r_[counts[1], 0], counts[2]
    out, names = np.flatnonzero(three & 1), own.names.cast(pa.string())
    for i in range(0, len(out), ROWS):
        at = out[i : i + ROWS]
        w2, w1, word, none = own.w2[at], own.w1[at], own.word[at], own.none
        text = lambda v: names.take(pa.array(v, mask=v == none))
        n = (one[word], np.where(w1 == none, 0, two[own.last[at]]), np.where(w2 == none, 0, three[at] >> 1), one[w1], np.where(w2 == none, 0, two[own.before[at]]))
        more = dict(zip(_COUNTS, n, strict=True))
        if value:
            more = {"value": value(more, w1 == none, w2 == none)}
        yield pa.RecordBatch.from_arrays([text(w2), text(w1), text(word), *map(pa.array, more.values())], ["w2", "w1", "word", *more])


@dataclass
class Counted:
    """Slices with their answers, all words and the distinct ones."""

    both: DataFrame
    mark: str
    total: int
    vocabulary: int

    def places(self, value: Value | None = None) -> DataFrame:
        """The distinct places as NgramModel.counted() has them (w2, w1, word, c1, c2, c3, h1, h2), or with one value of these counts.

        ``value`` gets the counts as arrays, and where w1 and w2 are none.
        """
        mark = self.mark

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, blobs = None, []
            for batch in batches:
                for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                    if part < 0:
                        if own is not None:
                            yield from _given(own, blobs, value)
                            own = None
                            _release()
                        own, blobs = Slice(blob.as_py(), mark), []
                    else:
                        blobs.append(blob.as_py())
            if own is not None:
                yield from _given(own, blobs, value)
                own, blobs = None, []
                _release()

        return self.both.mapInArrow(run, "w2 string, w1 string, word string, " + ("value double" if value else ", ".join(f"{c} long" for c in _COUNTS)))


def counted(texts: DataFrame, mark: str) -> Counted:
    """What all places of texts (one column, lower-cased, never null) ask for; a text begins with the mark, which is no word of any."""
    spark = texts.sparkSession
    slices = sliced(texts)
    total = int(slices.agg(F.sum("words")).first()[0] or 0)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(np.ceil(total * KEYS_A_WORD / ROUNDS / PART)))
    rounds = [range(r * owners, (r + 1) * owners) for r in range(ROUNDS)]
    answered = reduce(DataFrame.unionByName, [written(_answers(_questions(slices, mark, ROUNDS * owners, now), owners)) for now in rounds])
    vocabulary = int(answered.agg(F.sum("words")).first()[0] or 0)

    # a task for each slice: their numbers are those of the tasks that packed them, each from 0 on
    packers = slices.groupBy(F.shiftright("slice", 32).alias("packer")).count().orderBy("packer").collect()
    begins = list(zip([r.packer for r in packers], np.cumsum([0] + [r["count"] for r in packers]).tolist(), strict=False))
    both = slices.select("slice", F.lit(-1).alias("part"), "blob").unionByName(answered.select("slice", "part", "blob"))
    both = both.withColumn("packer", F.shiftright("slice", 32)).join(F.broadcast(spark.createDataFrame(begins, "packer long, begin long")), "packer")
    both = both.select("slice", "part", "blob", (F.col("begin") + F.col("slice").bitwiseAND(0xFFFFFFFF)).cast("int").alias("task"))
    both = both.repartitionById(max(1, sum(r["count"] for r in packers)), "task").sortWithinPartitions("slice", "part")
    return Counted(both, mark, total, vocabulary)
