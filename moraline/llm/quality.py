"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score is a logistic of b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2],
so all pairwise interactions cost one pass over a document's features. Features are
the distinct words (hashed, of unit length together) and statistics of the text: its
size, shares of letters, capitals, digits, symbols and line breaks, word lengths, and
how much of its words, word triples and lines repeat.

The machine is fitted on a bounded sample of labelled rows (``limit``); statistics and
scores always cover whole texts. Defined results: null text is the empty text and is
scored like any other; without labels of both kinds every score is the share of 1s (0.5
without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import crc, fresh, labelled, share, texts

LIMIT, BITS, RANK, EPOCHS, THRESHOLD = 12_000, 15, 6, 8, 0.3
FOLDS, HELD_OUT = 5, 0

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 small letter or UTF-8 part, 2 capital, 3 digit, 4 space, 5 line break, 6 stop, 7 symbol
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:?"]] = 6
_CLASS[[ord(c) for c in "!\"#$%&'()*+-/<=>@[\\]^_`{|}~"]] = 7
STATS = 16


def features(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's distinct words in one array, its offsets (one more than rows), and the rows' statistics."""
    data, offs = tx.flat(piece.column("text"))
    starts, ends, h, first = tx.words(data, offs)
    rows = len(offs) - 1
    cls = _CLASS[data]
    shares = np.empty((rows, 8))
    size = np.maximum(np.diff(offs), 1)
    for c in range(8):
        total = np.r_[0, np.cumsum(cls == c, dtype=np.int64)]
        shares[:, c] = (total[offs[1:]] - total[offs[:-1]]) / size
    closing = cls[ends - 1] == 7 if len(ends) else np.zeros(0, bool)  # words that end in a symbol
    caps = cls[starts] == 2 if len(starts) else np.zeros(0, bool)
    lengths = np.r_[0, np.cumsum(ends - starts)]
    closed, capital = np.r_[0, np.cumsum(closing)], np.r_[0, np.cumsum(caps)]
    triple = tx.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
    kept, stats = [], np.zeros((rows, STATS))
    stats[:, :8] = shares
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a
        u = tx.distinct(h[a:b])
        kept.append(u)
        if n:
            t = max(n - 2, 0)
            d3 = len(tx.distinct(triple[a : a + t])) / t if t else 1.0
            stats[i, 8:15] = np.log1p(n), (lengths[b] - lengths[a]) / n, len(u) / n, d3, (closed[b] - closed[a]) / n, (capital[b] - capital[a]) / n, t == 0
    stats[:, 15] = np.log1p(np.diff(offs))
    return (np.concatenate(kept) if kept else h[:0]), np.r_[0, np.cumsum([len(k) for k in kept])].astype(np.int64), stats


class FactorisationMachine:
    def __init__(self, bits: int = BITS, rank: int = RANK):
        self.bits, self.rank, self.bias = bits, rank, 0.0
        self.size = (1 << bits) + STATS
        self.w, self.v = np.zeros(self.size), np.zeros((self.size, rank))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def rows(self, words: np.ndarray, offs: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values of all rows, one after the other, and the rows' first places."""
        n = np.diff(offs)
        rows = len(n)
        z = np.clip((stats - self.mean) / self.scale, -5, 5) * 0.5
        at = offs[:-1] + np.arange(rows) * STATS
        idx, val = np.empty(len(words) + rows * STATS, np.int64), np.empty(len(words) + rows * STATS)
        own = (at[:, None] + np.arange(STATS)).ravel()
        rest = np.ones(len(idx), bool)
        rest[own] = False
        idx[own], val[own] = np.tile((1 << self.bits) + np.arange(STATS), rows), z.ravel()
        idx[rest], val[rest] = (words >> np.uint64(64 - self.bits)).astype(np.int64), np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
        return idx, val, at

    def margins(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0), np.zeros((0, self.rank))
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, at)
        return self.bias + np.add.reduceat(self.w[idx] * val, at) + 0.5 * (s**2 - np.add.reduceat(vx**2, at)).sum(1), s

    def fit(self, words: np.ndarray, offs: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, l2: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        rng = np.random.default_rng(seed)
        share = y.mean() if len(y) else 0.5
        self.bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        if share in (0.0, 1.0) or len(y) < 2:
            return self
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        self.v = rng.normal(0, 0.05, self.v.shape)
        # columns: w, then v; one Adam state for the features that a batch touches
        m, s = np.zeros((self.size, 1 + self.rank)), np.zeros((self.size, 1 + self.rank))
        mb = sb = 0.0
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            lr = rate * (1 - epoch / epochs) + 1e-3
            for i in range(0, len(order), 64):
                part = order[i : i + 64]
                w_part = np.concatenate([words[offs[j] : offs[j + 1]] for j in part])
                o_part = np.r_[0, np.cumsum(offs[part + 1] - offs[part])]
                idx, val, at = self.rows(w_part, o_part, stats[part])
                margin, sums = self.margins(idx, val, at)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
                n = np.diff(np.r_[at, len(idx)])
                gv = np.repeat(g, n) * val
                grad = np.empty((len(idx), 1 + self.rank))
                grad[:, 0] = gv
                grad[:, 1:] = gv[:, None] * (np.repeat(sums, n, axis=0) - self.v[idx] * val[:, None])
                u, inv = np.unique(idx, return_inverse=True)
                total = np.empty((len(u), 1 + self.rank))
                for c in range(1 + self.rank):
                    total[:, c] = np.bincount(inv, grad[:, c], len(u))
                total += l2 * np.c_[self.w[u], self.v[u]]
                step += 1
                m[u] = 0.9 * m[u] + 0.1 * total
                s[u] = 0.99 * s[u] + 0.01 * total**2
                move = lr * m[u] / (np.sqrt(s[u]) + 1e-6)
                self.w[u] -= move[:, 0]
                self.v[u] -= move[:, 1:]
                gb = g.sum()
                mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
                self.bias -= lr * mb / (np.sqrt(sb) + 1e-6)
        return self

    def scores(self, words: np.ndarray, offs: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(words, offs, stats))[0], -30, 30)))


def _gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for piece in tx.pieces(batch):
            words, offs, stats = features(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.LargeListArray.from_arrays(offs, words.view(np.int64)).cast(pa.list_(pa.int64())), pa.array(list(stats), pa.list_(pa.float64())), piece.column("label"), piece.column("doc_id")], ["words", "stats", "label", "doc_id"]
            )


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, **options) -> FactorisationMachine:
    """The machine for ``labels.quality``, from at most ``limit`` labelled rows outside the held-out fold."""
    got = labelled(docs, labels, "quality", FOLDS, HELD_OUT, limit).mapInArrow(tx.trimmed(_gather), "words array<long>, stats array<double>, label int, doc_id long").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return FactorisationMachine(**options)
    lists = got.column("words").combine_chunks()
    words, offs = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    stats = np.array(got.column("stats").to_pylist())
    return FactorisationMachine(**options).fit(words, offs, stats, got.column("label").to_numpy().astype(float))


def scored(docs: DataFrame, model: FactorisationMachine, *keep: str, name: str = "score") -> DataFrame:
    """doc_id, the columns ``keep``, and the score as ``name`` of every row; one scan without a shuffle."""
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys(["doc_id", "text", *keep])))
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{name}` double"])
    sent = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch):
                s = pa.array(sent.value.scores(*features(piece)), pa.float64())
                yield pa.RecordBatch.from_arrays([*piece.columns, s], [*piece.schema.names, name])

    out = rows.mapInArrow(tx.trimmed(run), schema)
    return out if "text" in keep else out.drop("text")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on, which counts as reached) for every document."""
    docs = texts(docs)
    out = scored(docs, fit(docs, labels, limit), "doc_id")
    return out.select("doc_id", (F.pmod(crc(), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score reaches the threshold; a score equal to it stays."""
    name = fresh("score", docs.columns)
    kept = scored(docs, fit(docs, labels, limit), *docs.columns, name=name).where(F.col(f"`{name}`") >= threshold)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
