"""Language-model scores by a weighted backoff automaton of words, bigrams and trigrams.

States are all n-grams (up to order 3) of the training texts, whatever their counts and
the size of the corpus. The arc of a word w after a history h weighs the logarithm of

    p(w | h) = k(h) c(hw) / c(h) + (1 - k(h)) p(w | h without its first word),

and its failure arc log(1 - k(h)): an interpolated model whose share k grows with the
count of the history, (c - 1) / (c - 1 + BETA sqrt(c)), so that a history that occurs once
says nothing. Below is the discounted share of the word among all tokens; unseen words
are one class with the rest of that mass, so probabilities sum to one over the words seen
and that class. A text is read once from left to right: the state is the longest history
seen, and log-probabilities add up.

The automaton is never in one place. Documents are packed into slices of SLICE bytes, a
row of a written table each, so what a slice holds never changes. A slice sends its
distinct n-grams, sorted and packed, to their owners by ranges of hashes, with their
counts in its training texts; the owner adds up and answers with the totals, in the order
of the question. Then each slice meets its answers and is read by the automaton of all
n-grams that occur in it, exact counts of the whole corpus included. A frequent n-gram
reaches its owner once for each slice, so no key is hot. Owners take the ranges in ROUNDS
parts one after the other, to hold less on disk; there are as many of them as keep a
range below about PART n-grams.

Tokens are lower-cased words and one end for each text; histories begin with an end.
N-grams are told apart by 61-bit hashes. Defined results: null text is the empty text,
which is its end alone; rows that repeat an id are counted and scored each; without
training texts every score is that of unseen words under a uniform guess of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import crc, partitions, texts, written

ORDER, DISCOUNT, BETA, FOLDS, HELD_OUT = 3, 0.75, 1.0, 5, 1
SLICE, PART, ROUNDS, GRAMS_A_BYTE, SORTED, SLICES_A_TASK = 5 << 20, 2_000_000, 2, 0.27, 1 << 18, 4
END = np.uint64(0xE4D0F7E87A1C3B55)
_SALT = tx.seeds(2, 91) | np.uint64(1)
_KEY = ~np.uint64(7)


def tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row led by the end before it and closed by its own, and the rows' first places."""
    data, offs = tx.flat(piece.column("text"))
    _, _, h, first = tx.words(data, offs)
    rows = len(first) - 1
    out = np.full(len(h) + 2 * rows, END)
    out[np.arange(len(h)) + 1 + 2 * np.repeat(np.arange(rows), np.diff(first))] = h
    return out, first + 2 * np.arange(rows + 1)


def grams(t: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. ORDER the places at which an n-gram of a row's text ends (n > 1: with the end before it), and its key.

    Keys are 61 bits of hash, two of n and a zero.
    """
    room = np.arange(len(t)) - np.repeat(begin[:-1], np.diff(begin))
    below = t
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(room >= max(n - 1, 1))
        key = below[at] if n == 1 else tx.mix(below[at - 1] * _SALT[0] ^ below[at] * _SALT[1])
        key = (key & _KEY) | np.uint64(2 * n)
        yield at, key
        if n < ORDER:
            below = below.copy() if n == 1 else np.zeros(len(t), np.uint64)
            below[at] = key


def runs(ordered: np.ndarray) -> np.ndarray:
    """The first place of each run of equals."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def in_order(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places of all keys in ascending order, those keys and the first place of each run of equals.

    They come in parts of about SORTED keys, each with all places of the keys it has, so that
    what sorting needs besides the keys themselves doesn't grow with them.
    """
    if not len(keys):
        return
    low, high, parts = int(keys.min()), int(keys.max()), -(-len(keys) // SORTED)
    bounds = [np.uint64(low + (high - low) * j // parts) for j in range(parts)]
    for j, bound in enumerate(bounds):
        at = np.flatnonzero((keys >= bound) & (keys < bounds[j + 1]) if j + 1 < parts else keys >= bound)
        if len(at):
            own = keys[at]
            order = tx.order_of(own)
            own = own[order]
            yield at[order], own, runs(own)


class Automaton:
    """All n-grams (sorted keys) with their counts in the training texts, whose tokens and distinct words are given.

    Without ``keys`` these are the distinct n-grams of the texts that are to be read, as others have no arc there.
    """

    def __init__(self, keys: np.ndarray | None, counts: np.ndarray, total: int, distinct: int):
        self.keys, self.counts, self.total, self.distinct = keys, counts, total, distinct
        self.unseen = DISCOUNT * distinct / total if total else 1.0

    @classmethod
    def of(cls, piece: pa.RecordBatch) -> Automaton:
        """The model of the rows of one batch."""
        keys = np.concatenate([k for _, k in grams(*tokens(piece))])
        keys, counts = np.unique(keys, return_counts=True)
        words = counts[keys & np.uint64(6) == 2]
        return cls(keys, counts, int(words.sum()), len(words))

    def occurrences(self, t: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """For n = 1 .. ORDER the counts of the n-gram that ends at each place, 0 where none does; the end before a row has the ends' count."""
        found = list(grams(t, begin))
        places, keys = [at for at, _ in found], np.concatenate([k for _, k in found])
        del found
        each, done = np.empty(len(keys), np.int64), 0
        for order, own, first in in_order(keys):
            if self.keys is None:
                have, done = self.counts[done : done + len(first)], done + len(first)
                if len(have) != len(first):
                    break
            else:
                at = tx.found(self.keys, own[first])
                have = np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)
            each[order] = np.repeat(have, np.diff(np.r_[first, len(own)]))
        if self.keys is None and done != len(self.counts):
            raise RuntimeError("a slice and its answers differ")
        del keys
        out, done = [], 0
        for at in places:
            c = np.zeros(len(t), np.int64)
            c[at] = each[done : done + len(at)]
            out.append(c)
            done += len(at)
        out[0][begin[:-1]] = out[0][begin[1:] - 1]  # each row closes with an end
        return out

    def read(self, t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10-weights on the way through the automaton at each token (0 for the ends before rows), and the words' counts."""
        c = self.occurrences(t, begin)
        p = np.where(c[0] > 0, (c[0] - DISCOUNT) / max(self.total, 1), self.unseen)
        for n in range(2, len(c) + 1):
            h = np.r_[0, c[n - 2][:-1]].astype(float)
            if n > 2:  # a bigram that ends where a row begins is not there, so neither is a history
                h[begin[:-1]] = 0
            share = np.where(h > 1, (h - 1) / (h - 1 + BETA * np.sqrt(h)), 0.0)
            p = share * c[n - 1] / np.maximum(h, 1) + (1 - share) * p
        out = np.log10(np.maximum(p, 1e-300))
        out[begin[:-1]] = 0
        return out, c[0]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers below 2^64 in as few bytes each as the largest needs, byte planes apart, compressed."""
    wide = next(w for w in (1, 2, 4, 8) if not len(x) or w == 8 or int(x.max()) < 1 << 8 * w)
    planes = np.ascontiguousarray(x.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T)
    return bytes([wide]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    wide = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], wide * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(f"<u{wide}").ravel()


def sliced(docs: DataFrame) -> DataFrame:
    """slice, bytes (of text) and docs (doc_id, text, held_out as a compressed Arrow stream) of every SLICE bytes, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for piece in held:
                    out.write_batch(piece)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "bytes", "docs"])

        for batch in batches:
            for piece in tx.pieces(batch):
                held.append(piece)
                size += len(tx.flat(piece.column("text"))[0])
                if size >= SLICE:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    held_out = F.coalesce(F.pmod(crc(), F.lit(FOLDS)) == HELD_OUT, F.lit(False)).alias("held_out")
    return written(texts(docs).select("doc_id", "text", held_out).mapInArrow(tx.trimmed(run), "slice long, bytes long, docs binary"))


def documents(data: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(data) as stream:
        yield from stream


def edges(owners: int) -> np.ndarray:
    """Where the key range of each owner begins, and the end of the last."""
    return np.array([(j << 64) // owners for j in range(owners)] + [2**64 - 1], np.uint64)


def questions(slices: DataFrame, owners: int, part: range) -> DataFrame:
    """part, slice, n, keys, counts: the slices' distinct n-grams in the ranges of ``part``, and how often their training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = edges(owners)[part.start : part.stop + 1]
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("docs"), strict=True):
                held = []
                for piece in documents(data.as_buffer()):
                    t, begin = tokens(piece)
                    out = np.repeat(piece.column("held_out").to_numpy(zero_copy_only=False), np.diff(begin)).astype(np.uint64)
                    for at, key in grams(t, begin):
                        own = (key >= bounds[0]) & (key < bounds[-1])
                        held.append(key[own] | out[at[own]])
                keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
                first = runs(keys >> np.uint64(1))
                if not len(first):
                    continue
                n = np.diff(np.r_[first, len(keys)]) - np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)
                keys = keys[first] & ~np.uint64(1)
                cut = np.searchsorted(keys, bounds)
                rows = [
                    (j, number, int(b - a), packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(n[a:b]))
                    for j, a, b in zip(part, cut[:-1], cut[1:], strict=True)
                    if b > a
                ]
                tx.release()
                yield pa.RecordBatch.from_pylist([dict(zip(_QUESTION.names, r, strict=True)) for r in rows], _QUESTION)

    return slices.select("slice", "docs").mapInArrow(tx.trimmed(run), "part long, slice long, n long, keys binary, counts binary")


_QUESTION = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64())])


def answers(asked: DataFrame, owners: int) -> DataFrame:
    """slice, part, n, payload (totals in the order of the question); and, once for each part, its distinct words and their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sent = [], []
        for batch in batches:
            for part, number, n, k, c in zip(*(batch.column(x) for x in _QUESTION.names), strict=True):
                heads.append((number.as_py(), part.as_py(), n.as_py()))
                sent.append((k.as_py(), c.as_py()))
        if not heads:
            return
        size = sum(n for _, _, n in heads)
        keys, counts, done = np.empty(size, np.uint64), np.empty(size, np.int64), 0
        for (_, _, n), (k, c) in zip(heads, sent, strict=True):
            np.cumsum(unpacked(k, n), dtype=np.uint64, out=keys[done : done + n])
            counts[done : done + n] = unpacked(c, n)
            done += n
        del sent
        stats = np.zeros(2, np.int64)
        for order, own, first in in_order(keys):
            total = np.add.reduceat(counts[order], first)
            words = total[(own[first] & np.uint64(6) == 2) & (total > 0)]
            stats += len(words), words.sum()
            counts[order] = np.repeat(total, np.diff(np.r_[first, len(order)]))
        del keys
        done, stats = 0, stats.tolist()
        for number, part, n in heads:
            yield pa.RecordBatch.from_pylist([dict(zip(_ANSWER.names, (number, part, n, packed(counts[done : done + n]), *stats), strict=True))], _ANSWER)
            done, stats = done + n, (0, 0)

    return asked.repartitionById(owners, F.pmod(F.col("part"), F.lit(owners)).cast("int")).mapInArrow(tx.trimmed(run), "slice long, part long, n long, payload binary, words long, tokens long")


def counted(slices: DataFrame) -> tuple[DataFrame, int, int]:
    """The answers to all slices, the tokens of the training texts and their distinct words."""
    size = slices.agg(F.sum("bytes")).first()[0] or 0
    owners = max(partitions(slices.sparkSession), int(np.ceil(size * GRAMS_A_BYTE / ROUNDS / PART)))
    out = None
    for r in range(ROUNDS):
        got = written(answers(questions(slices, ROUNDS * owners, range(r * owners, (r + 1) * owners)), owners))
        out = got if out is None else out.unionByName(got)
    row = out.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    return out, int(row.tokens or 0), int(row.words or 0)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(slices: DataFrame, answered: DataFrame, total: int, distinct: int) -> DataFrame:
    """The columns of _SCORES, each slice read by the automaton of its own n-grams."""
    own = slices.select("slice", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("n"), F.col("docs").alias("payload"))
    # slices are numbered anew from 0 on, a few neighbours for a task: their numbers are those of the tasks that packed them, each from 0 on
    packers = slices.groupBy(F.shiftright("slice", 32).alias("packer")).count().orderBy("packer").collect()
    begins = dict(zip([r.packer for r in packers], np.cumsum([0] + [r["count"] for r in packers]).tolist(), strict=False))
    offsets = slices.sparkSession.createDataFrame(list(begins.items()), "packer long, offset long")
    both = own.unionByName(answered.select("slice", "part", "n", "payload")).withColumn("packer", F.shiftright("slice", 32)).join(F.broadcast(offsets), "packer")
    number = sum(r["count"] for r in packers)
    together = min(max(number // partitions(slices.sparkSession), 1), SLICES_A_TASK)
    task = F.floor((F.col("offset") + F.col("slice").bitwiseAND(0xFFFFFFFF)) / together).cast("int")
    both = both.select("slice", "part", "n", "payload", task.alias("task")).repartitionById(max(1, -(-number // together)), "task").sortWithinPartitions("slice", "part")

    def read(data: pa.Buffer, counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pieces = list(documents(data))
        parts = [tokens(p) for p in pieces]
        starts = np.cumsum([0] + [len(t) for t, _ in parts])
        t = np.concatenate([t for t, _ in parts])
        begin = np.concatenate([b[:-1] + s for (_, b), s in zip(parts, starts[:-1], strict=True)] + [starts[-1:]])
        weights, c = Automaton(None, np.concatenate(counts), total, distinct).read(t, begin)
        n = np.diff(begin) - 1
        inside = np.ones(len(t), bool)
        inside[begin[:-1]] = False
        base = np.where(inside, np.log10(c + 0.5), 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([p.column("doc_id") for p in pieces]),
                pa.concat_arrays([p.column("held_out") for p in pieces]),
                pa.array(n),
                pa.array(np.add.reduceat((c > 0) & inside, begin[:-1], dtype=np.int64)),
                pa.array(np.add.reduceat(base, begin[:-1]) - n * np.log10(total + 0.5 * (distinct + 1))),
                pa.array(np.add.reduceat(weights, begin[:-1])),
            ],
            [f.split()[0] for f in _SCORES.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, counts = None, []
        for batch in batches:
            for part, n, payload in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("payload"), strict=True):
                if part < 0:
                    if data is not None:
                        yield from read(data, counts)
                        tx.release()
                    data, counts = payload.as_buffer(), []
                else:
                    counts.append(unpacked(payload.as_py(), n).astype(np.int64))
        if data is not None:
            yield from read(data, counts)

    return both.mapInArrow(tx.trimmed(run), _SCORES)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    slices = sliced(docs)
    answered, total, distinct = counted(slices)
    return scored(slices, answered, total, distinct).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
