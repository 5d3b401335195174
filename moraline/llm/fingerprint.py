"""I-Match document fingerprints over several randomised lexicon subsets.

Terms are words whose document frequency lies in a chosen band. A fingerprint has the hash of a document's sorted distinct terms, and the same for
LEVELS x SUBSETS random subsets of the lexicon, which are fixed for all documents: subset k
of level j holds a term when the term's k-th hash is below 2^-j, so a level has half the
terms of the one before it, and there are subsets that keep a few terms of a note as well
as of a book. Two fingerprints are compared where subsets keep few terms: at the sparsest
level at which half of them have terms of either document, and at the next one. Their
likeness is the share of equal hashes there among the subsets that either has terms in.

The words of a text that is a tenth of a corpus, by its copies, leave the band; so a
document with fewer than FEW terms in the band is filled up to so many with other words of
its own, those of the smallest hashes, and like texts still get like terms.

Defined results: null text is the empty text; a document without words has hashes of
nothing, which are zeros; equal fingerprints, also two of these, have likeness 1. Equal
texts have equal fingerprints.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import frequent, partitions, share, texts, written

LEVELS, SUBSETS, FEW = 11, 16, 12
LOW, HIGH = 1 / 2000, 1 / 10
_STEP = np.uint64(0xD1342543DE82EF95)


def _distinct_words(piece: pa.RecordBatch) -> tuple[np.ndarray, int]:
    data, offs = tx.flat(piece.column("text"))
    _, _, h, first = tx.words(data, offs)
    parts = [tx.distinct(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
    return (np.concatenate(parts) if parts else h[:0]), piece.num_rows


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the words that occur in a share ``low`` to ``high`` of all documents.

    At most (mean distinct words of a document) / low of them.
    """
    keys, df, n = frequent(texts(docs).select("text"), _distinct_words, low)
    return keys[df <= high * n]


class Fingerprinter:
    """Fingerprints of texts for one lexicon; a value that tasks can carry."""

    def __init__(self, terms: np.ndarray, levels: int = LEVELS, subsets: int = SUBSETS, few: int = FEW, seed: int = 7):
        self.terms, self.levels, self.subsets, self.few = terms, levels, subsets, few
        self.salt = tx.seeds(subsets, seed) | np.uint64(1)

    def of_texts(self, col: pa.Array) -> Prints:
        data, offs = tx.flat(col)
        _, _, h, first = tx.words(data, offs)
        row = np.repeat(np.arange(len(col)), np.diff(first))
        some = np.flatnonzero(tx.found(self.terms, h) >= 0)
        terms, own = distinct_in_rows(h[some], row[some])
        have = np.bincount(own, minlength=len(col))
        poor = have < self.few
        if poor[row].any():
            some = np.flatnonzero(poor[row])
            more, rows = distinct_in_rows(h[some], row[some])
            other = tx.found(self.terms, more) < 0
            more, rows = more[other], rows[other]
            order = np.lexsort((tx.mix(more), rows))
            first = np.searchsorted(rows, np.arange(len(col)))  # rows ascend, in either order
            taken = order[np.arange(len(rows)) - first[rows] < (self.few - have)[rows]]
            terms, own = np.r_[terms, more[taken]], np.r_[own, rows[taken]]
            order = np.lexsort((terms, own))
            terms, own = terms[order], own[order]
        return self.of_terms(terms, own, len(col))

    def of_terms(self, terms: np.ndarray, row: np.ndarray, rows: int) -> Prints:
        """Of the distinct terms of each row, sorted within rows."""
        value = tx.mix(terms)
        whole = sequence_hashes(value, row, rows)
        cells = np.zeros((rows, self.levels, self.subsets), np.uint16)
        drawn = (terms ^ (terms >> np.uint64(29))) * self.salt[:, None]
        drawn ^= drawn >> np.uint64(32)
        drawn *= np.uint64(0xD6E8FEB86659FD93)
        subset, at = np.nonzero(drawn >> np.uint64(63) == 0)
        drawn = drawn[subset, at]
        for level in range(self.levels):
            if level:
                inside = np.flatnonzero(drawn >> np.uint64(63 - level) == 0)
                subset, at, drawn = subset[inside], at[inside], drawn[inside]
            h = sequence_hashes(value[at], subset * rows + row[at], self.subsets * rows)
            short = np.where(h > 0, (h >> np.uint64(40)).astype(np.uint16) | 1, 0)
            cells[:, level] = short.reshape(self.subsets, rows).T
        return Prints(whole, cells)


def distinct_in_rows(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order; rows ascend."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[new], row[new]


def sequence_hashes(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The hash of each group's values in their order (h = h * step + value for one after the other); 0 for groups without any."""
    out = np.zeros(groups, np.uint64)
    if len(values):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        after = np.repeat(first + size, size) - 1 - np.arange(len(group))
        power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), _STEP)])
        out[group[first]] = tx.mix(np.add.reduceat(values * power[after], first) + size.astype(np.uint64)) | np.uint64(1)
    return out


class Prints:
    """Fingerprints of several texts: 64-bit hashes over the whole lexicon, and 16 bits for each level and subset; 0 stands for no terms."""

    def __init__(self, whole: np.ndarray, cells: np.ndarray):
        self.whole, self.cells = whole, cells

    def take(self, rows) -> Prints:
        return Prints(self.whole[rows], self.cells[rows])

    def and_(self, other: Prints) -> Prints:
        return Prints(np.r_[self.whole, other.whole], np.r_[self.cells, other.cells])

    def as_text(self) -> list[str]:
        cells = self.cells.astype(">u2")
        return [f"{int(w):016x}{c.tobytes().hex()}" for w, c in zip(self.whole, cells, strict=True)]

    @classmethod
    def from_text(cls, texts: list[str], subsets: int = SUBSETS) -> Prints:
        cells = [np.frombuffer(bytes.fromhex(t[16:]), ">u2").astype(np.uint16).reshape(-1, subsets) for t in texts]
        return cls(np.array([int(t[:16], 16) for t in texts], np.uint64), np.array(cells))

    def likeness(self, other: Prints) -> np.ndarray:
        """Of the fingerprints at the same places."""
        some = (self.cells > 0) | (other.cells > 0)
        equal = some & (self.cells == other.cells)
        n, same = some.sum(2), equal.sum(2)
        levels = n.shape[1]
        enough = 2 * n >= some.shape[2]
        level = np.where(enough.any(1), levels - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        rows, after = np.arange(len(n)), np.minimum(level + 1, levels - 1)
        next_ = after > level
        total = n[rows, level] + np.where(next_, n[rows, after], 0)
        share = (same[rows, level] + np.where(next_, same[rows, after], 0)) / np.maximum(total, 1)
        return np.where((self.whole == other.whole) & (self.cells == other.cells).all((1, 2)), 1.0, share)


def fingerprints(docs: DataFrame, terms: np.ndarray | None = None, **options) -> DataFrame:
    """doc_id, n_terms and fingerprint of every document; one scan beside the lexicon's two."""
    docs = texts(docs)
    sent = share(docs.sparkSession, Fingerprinter(lexicon(docs) if terms is None else terms, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch):
                prints = sent.value.of_texts(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(prints.as_text(), pa.string())], ["doc_id", "fingerprint"])

    return docs.mapInArrow(tx.trimmed(run), "doc_id long, fingerprint string")


def slots(ids: DataFrame, n: int) -> tuple[Column, Column, int]:
    """For rows (doc_id, text) a slot, ascending with doc_id and then the second column, which is that column's value, and the number of slots.

    Cuts are quantiles of the ids, read without texts. An id with several quantiles of all
    rows, or null, gets several slots, by ranges of a hash of the texts; without such an
    id the second column is 0 and texts are not read for it. Null ids come last.
    """
    total, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    cuts = collections.Counter(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 and known else [])
    marks = sorted(cuts)
    hash_ = F.xxhash64("text")
    share = (F.shiftright(hash_, 40) + (1 << 23)) / float(1 << 24)  # of all hashes that are lower, in order
    spread = lambda first, k: (F.lit(first) + F.floor(share * k)).cast("int")
    hot, leaves, used = [m for m in marks if cuts[m] > 1], [F.lit(0)], 1
    for m in marks:
        if cuts[m] > 1:
            own = spread(used, cuts[m])
            used += cuts[m]
            leaves.append(F.when(F.col("doc_id") == int(m), own).otherwise(F.lit(used)))
        else:
            leaves.append(F.lit(used))
        used += 1

    def tree(lo: int, hi: int) -> Column:  # log2(n) comparisons for each row, in generated code
        if lo == hi:
            return leaves[lo]
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < int(marks[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    nulls = max(1, round(n * (total - known) / max(total, 1)))
    slot = F.when(F.col("doc_id").isNull(), spread(used, nulls) if nulls > 1 else F.lit(used)).otherwise(tree(0, len(marks)))
    split = F.col("doc_id").isin([int(m) for m in hot]) if hot else F.lit(False)
    split = split | F.col("doc_id").isNull() if nulls > 1 else split
    return slot, F.when(split, hash_).otherwise(F.lit(0)) if hot or nulls > 1 else F.lit(0).cast("long"), used + nulls


def in_order(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """doc_id, text, slot, extra, second: slots of ascending doc_id, a partition each, followed by a copy of the document after them.

    The copy (extra = 1) is the first document of the next slot with rows, or of all after
    the last, so every task sees each document's successor, and texts are shuffled once.
    Equal ids are ordered by the second key of slots(), then by their texts.
    """
    docs = texts(docs)
    slot, second, n = slots(docs, buckets or partitions(docs.sparkSession))
    own = docs.select("doc_id", "text", slot.alias("slot"), F.lit(0).alias("extra"), second.alias("second"))
    # a row for each slot, in one task as a window: its first id, and the slot before
    heads = own.groupBy("slot").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "second")).alias("first"))
    around = Window.orderBy("slot")
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("slot").over(around), F.max("slot").over(whole))
    heads = written(heads.select(F.col("first.doc_id").alias("head"), F.col("first.second").alias("at"), before.alias("to")))
    copies = own.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("second") == F.col("at")))
    one = copies.groupBy("to", "doc_id", "second").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    extra = one.select("doc_id", "text", F.col("to").alias("slot"), F.lit(1).alias("extra"), "second")
    return own.unionByName(extra), n


def edited(text: str, after: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the one after it."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_report(docs: DataFrame, terms: np.ndarray | None = None, **options) -> DataFrame:
    """Each document's fingerprint beside its edited text's and its successor's.

    With a single document the successor is the document itself.
    """
    sent = share(docs.sparkSession, Fingerprinter(lexicon(docs) if terms is None else terms, **options))
    ranged, n = in_order(docs)
    ranged = ranged.repartitionById(n, F.col("slot")).sortWithinPartitions("slot", "extra", "doc_id", "second", "text").drop("second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, last = sent.value, None  # last: the row whose successor is still to come, and its fingerprint

        for batch in batches:
            for piece in tx.pieces(batch):
                rows = list(zip(piece.column("doc_id").to_pylist(), [t or "" for t in piece.column("text").to_pylist()], piece.column("slot").to_pylist(), piece.column("extra").to_pylist(), strict=True))
                prints = fp.of_texts(piece.column("text"))
                if last is not None:
                    rows, prints = [last[0], *rows], last[1].and_(prints)
                last = rows[-1], prints.take([-1])
                # a second copy for the same slot follows the first one and is nobody's successor
                at = np.array([i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[3] == 0 and a[2] == b[2]], np.int64)
                if not len(at):
                    continue
                new = pa.array([edited(rows[i][1], rows[i + 1][1]) for i in at], pa.large_string())
                own, news = prints.take(at), fp.of_texts(new)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([rows[i][0] for i in at], pa.int64()),
                        "n_chars": pa.array([len(rows[i][1]) for i in at], pa.int64()),
                        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new.to_pylist()],
                        "fingerprint": own.as_text(),
                        "edited_fingerprint": news.as_text(),
                        "near_edited": own.likeness(news),
                        "near_next": own.likeness(prints.take(at + 1)),
                    }
                )

    return ranged.mapInArrow(tx.trimmed(run), _PAIRS)
