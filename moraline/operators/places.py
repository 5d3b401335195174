"""Counts of all three-word places of a corpus, which travel as compressed pieces.

A place is (w2, w1, word) as in ngram.spans(), and an end after the last word of a
sentence. All places after the same two words meet in one task, so both the count of a
place and that of its two words come from one shuffle, of a fraction of the strings'
size: a task numbers its words, counts its places, and sends those of a bucket with the
words that they need. Tasks hold FLUSH words on the one side and about BUCKET places on
the other, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH, BUCKET, ROWS = 1_000_000, 1_500_000, 50_000
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[9, 10, 13]] = 32
_M = np.uint64(0x9E3779B97F4A7C15)


def _places(ids: np.ndarray, n: np.ndarray, none: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w2, w1 and word of sentences of ``n`` words each, an end after each."""
    start = np.cumsum(n + 3) - (n + 3)
    all_ = np.full(int((n + 3).sum()), none, np.int64)
    inside = np.ones(len(all_), bool)
    inside[start] = inside[start + 1] = False
    last = start + n + 2
    all_[last] = end
    words = inside.copy()
    words[last] = False
    all_[words] = ids
    at = np.flatnonzero(inside)
    return all_[at - 2], all_[at - 1], all_[at]


def _counted(w2: np.ndarray, w1: np.ndarray, word: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, ...]:
    """pair number, word and count of distinct places, in order; and the pairs (w2 * size + w1)."""
    pairs, pair = np.unique(w2 * size + w1, return_inverse=True)
    key = pair * size + word
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key, n = key[first], np.add.reduceat(n, first) if len(key) else n
    return key // size, key % size, n, pairs


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of numbers below 2^32 in as few bytes as they need, and bytes, compressed."""
    out = []
    for p in parts:
        if not isinstance(p, bytes):
            top = int(p.max()) if len(p) else 0
            p = p.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
            out.append(np.array([p.itemsize, len(p)], np.int64).tobytes() + p.tobytes())
        else:
            out.append(np.array([0, len(p)], np.int64).tobytes() + p)
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list:
    raw, out, at = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), [], 0
    while at < len(raw):
        item, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        out.append(np.frombuffer(raw, f"u{item}", n, at).astype(np.int64) if item else raw[at : at + n])
        at += n * max(item, 1)
    return out


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int64).tobytes()), pa.py_buffer(data)])


def _bytes(words: pa.Array) -> tuple[np.ndarray, bytes]:
    offs = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    return np.diff(offs), words.buffers()[2].to_pybytes()[offs[0] : offs[-1]] if len(words) and words.buffers()[2] else b""


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between blanks, tabs and line breaks of all texts, and how many each has."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offs, data = texts.buffers()[1], texts.buffers()[2]
    data = pa.py_buffer(_BLANK[np.frombuffer(data, np.uint8)].tobytes()) if data else data
    parts = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offs, data], offset=texts.offset), " ")
    flat, row = parts.flatten(), np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.not_equal(flat, "")
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _flushes(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    held, lengths, n = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 100):  # some texts at a time, so that long ones don't add up
            words, each = _words(batch.column(0).slice(i, 100))
            held.append(words)
            lengths.append(each)
            n += len(words) + len(each)
            if n >= (most or FLUSH):
                yield pa.concat_arrays(held), np.concatenate(lengths)
                held, lengths, n = [], [], 0
    if n:
        yield pa.concat_arrays(held), np.concatenate(lengths)


def _send(words: pa.Array, lengths: np.ndarray, mark: str, buckets: int) -> Iterator[pa.RecordBatch]:
    known = words.dictionary_encode()
    names = pa.concat_arrays([known.dictionary, pa.array([mark], pa.large_string())])
    end, none, size = len(names), len(names) + 1, len(names) + 2
    ids = np.insert(known.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths) - lengths, len(names) - 1)
    w2, w1, word = _places(ids, lengths + 1, none, end)
    pair, word, n, pairs = _counted(w2, w1, word, None, size)
    h = np.r_[pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False), np.uint64(1), np.uint64(2)].astype(np.uint64)
    mixed = (h[pairs // size] * _M ^ h[pairs % size]) * _M
    bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)[pair]
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    local = np.zeros(size, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        at = order[a:b]
        x, y, z = pairs[pair[at]] // size, pairs[pair[at]] % size, word[at]
        used = np.unique(np.r_[x, y, z])
        used = used[used < end]
        local[used] = np.arange(2, len(used) + 2)  # 0: nothing before, 1: the end
        local[none], local[end] = 0, 1
        size_of, data = _bytes(names.take(pa.array(used)))
        blob = _pack(local[x], local[y], local[z], n[at], size_of, data)
        yield pa.RecordBatch.from_arrays([pa.array([bucket[order[a]]], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])


def _met(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    rows, names, have = [], [], 0
    for blob in blobs:
        x, y, z, n, size_of, data = _unpack(blob)
        names.append(_strings(size_of, data))
        rows.append([np.where(v > 1, v + have, v) for v in (x, y, z)] + [n])
        have += len(size_of)
    known = pa.concat_arrays(names).dictionary_encode()
    names, ids = known.dictionary, np.r_[0, 1, known.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2]
    size = len(names) + 2
    x, y, z, n = (np.concatenate(v) for v in zip(*rows, strict=True))
    pair, word, n, pairs = _counted(ids[x], ids[y], ids[z], n, size)
    both = np.bincount(pair, weights=n, minlength=len(pairs)).astype(np.int64)
    keep = np.flatnonzero(word != 1)
    for i in range(0, len(keep), ROWS):
        at = keep[i : i + ROWS]
        p = pairs[pair[at]]
        text = lambda v: names.take(pa.array(v - 2, mask=v < 2)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([text(p // size), text(p % size), text(word[at]), pa.array(n[at]), pa.array(both[pair[at]])], ["w2", "w1", "word", "n", "pair"])


def vocabulary(texts: DataFrame, mark: str) -> DataFrame:
    """word, count of texts (one column, lower-cased, never null), and the mark, once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lengths in _flushes(batches):
            got = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([pa.array([mark]), pa.array([len(lengths)], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.string()), got.field(1)], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))


def counted(texts: DataFrame, total: int, mark: str) -> DataFrame:
    """w2, w1, word, n, pair of texts (one column, lower-cased, never null) of ``total`` words: how often the place occurs, and how often w2 w1 does.

    A text begins with the mark, which is no word of any.
    """
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lengths in _flushes(batches):
            yield from _send(words, lengths, mark, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if blobs:
            yield from _met(blobs)

    sent = texts.mapInArrow(send, "bucket int, blob binary").repartitionById(buckets, F.col("bucket"))
    return sent.mapInArrow(meet, "w2 string, w1 string, word string, n long, pair long")
