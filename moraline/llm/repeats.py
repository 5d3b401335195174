"""Repeated byte strings of a corpus, by a logarithmic family of sparse suffix arrays.

Every window of ``length`` bytes has an anchor: the first of its ``length/2``-byte strings
with the smallest hash. Equal windows have equal anchors at the same place, so suffixes
need only start where the windows of an anchor do, about one for each ``length/4`` bytes;
a suffix is read as far as those windows go, its context. In each task new batches of
texts get a suffix array, in the order of their bytes and with the lengths of common
prefixes; it is scanned against the existing levels for matches as long as a context, and
levels of equal size are merged (``Family``). Every window is decided exactly, up to
64-bit fingerprints of contexts:

1. each task has a family of its own; contexts that occur again there are repeated as a
   whole;
2. what is left, one entry for each distinct context of a task, goes without its bytes, as
   fingerprints of anchor and context. Spark sorts these, and a scan of the sorted runs
   finds contexts that occur in several tasks. An anchor that is met with different
   contexts only marks an edge of a repeat;
3. edges are looked at in cells of ``CELL`` windows, whose common bytes take the part of
   the anchor, in the same two steps, and edges of those window by window.

A string that very many documents share reaches a round's second step once for each task,
not once for each document, and the scan holds one run of equals at a time, so no task
gathers a frequent passage.

Defined results: null text is the empty text; texts shorter than ``length`` bytes lose
nothing; matches never cross rows; rows that repeat an id and a text count as
occurrences of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import only, partitions, texts, written

LENGTH, CELL = 200, 12
_PLACE = np.uint64((1 << 21) - 1)
FLUSH, VARIANTS = 100_000, 16  # entries of a family, some 5 MB of text
ENTRY, REPEATED, EDGE, WITNESS, PASSED = 0, 1, 3, 4, 8  # WITNESS: known to be repeated, others may still meet it


class Level:
    """A sparse suffix array: starts and sizes of suffixes of ``data`` in the order of their bytes, the prefix that each
    has in common with the one before it, whether all of it occurs again, and a payload."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, again: np.ndarray, payload: list[np.ndarray]):
        self.blocks = tx.blocks(data)
        self.data = self.blocks.base[: len(data)]
        self.start, self.size, self.again, self.payload = start, size, again, payload
        self._sort()

    def __len__(self) -> int:
        return len(self.start)

    def word(self, rows: np.ndarray, j: int) -> np.ndarray:
        """The j-th eight bytes of suffixes as a number that orders as they do; zeros follow a suffix."""
        at = np.minimum(self.start[rows] + 8 * j, len(self.data))
        return self.blocks[at].byteswap() & _FIRST[np.clip(self.size[rows] - 8 * j, 0, 8)]

    def _sort(self) -> None:
        """By the first eight bytes, then those that are still equal by the next, and so on."""
        every = np.arange(len(self.start))
        word = self.word(every, 0)
        order = np.argsort(word, kind="stable")
        tied, run = _tied(word[order])
        j, deepest = 1, int(self.size.max(initial=0))
        while len(tied) and 8 * j < deepest:
            word = self.word(order[tied], j)
            by = np.lexsort((word, run))
            order[tied] = order[tied][by]
            some, run = _tied(word[by], run[by])
            tied = tied[some]
            j += 1
        self.start, self.size, self.again = self.start[order], self.size[order], self.again[order]
        self.payload = [p[order] for p in self.payload]
        self.first = self.word(every, 0)
        self.common = np.zeros(len(every), np.int64)
        self.common[1:] = compared(self, every[:-1], self, every[1:])[0]
        whole = self.common[1:] >= self.size[:-1]  # the next one begins with all of it
        self.again[:-1] |= whole
        self.again[1:] |= self.common[1:] >= self.size[1:]

    def scan(self, new: Level) -> None:
        """Marks suffixes of either array that occur as a whole in the other: the nearest in order have the longest common prefix."""
        lo, hi = np.searchsorted(self.first, new.first, "left"), np.searchsorted(self.first, new.first, "right")
        rows = np.flatnonzero(lo < hi)  # others part within eight bytes
        lo, hi = lo[rows], hi[rows]
        top, bottom = hi.copy(), lo.copy()
        while (open_ := lo < hi).any():
            at = np.flatnonzero(open_)
            mid = (lo[at] + hi[at]) // 2
            less = compared(self, mid, new, rows[at])[1]
            lo[at], hi[at] = np.where(less, mid + 1, lo[at]), np.where(less, hi[at], mid)
        for near in (lo - 1, lo):
            some = (near >= bottom) & (near < top)
            a, b = near[some], rows[some]
            common = compared(self, a, new, b)[0]
            self.again[a[common >= self.size[a]]] = True
            new.again[b[common >= new.size[b]]] = True

    def merged(self, other: Level) -> Level:
        return Level(
            np.r_[self.data, other.data],
            np.r_[self.start, other.start + len(self.data)],
            np.r_[self.size, other.size],
            np.r_[self.again, other.again],
            [np.r_[x, y] for x, y in zip(self.payload, other.payload, strict=True)],
        )


_FIRST = np.array([0] + [(2**64 - 1) ^ ((1 << 8 * (8 - k)) - 1) for k in range(1, 9)], np.uint64)  # keeps the first k bytes
_BYTES = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)


def _tied(word: np.ndarray, run: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places of entries that equal a neighbour, and the number of their run of equals."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, (word[1:] != word[:-1]) | (run is not None and run[1:] != run[:-1])]
    tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
    return tied, np.cumsum(new)[tied]


def compared(a: Level, i: np.ndarray, b: Level, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of suffixes the bytes that they have in common, and whether the first comes before the second."""
    size = np.minimum(a.size[i], b.size[j])
    common, less = size.copy(), a.size[i] < b.size[j]
    left, at = np.arange(len(i)), 0
    while len(left):
        x, y = a.word(i[left], at), b.word(j[left], at)
        apart = np.flatnonzero(x != y)
        same = 7 - np.searchsorted(_BYTES, x[apart] ^ y[apart], "right")
        common[left[apart]] = np.minimum(size[left[apart]], 8 * at + same)
        less[left[apart]] = x[apart] < y[apart]
        at += 1
        left = left[(x == y) & (size[left] > 8 * at)]
    return common, less


class Family:
    """Levels of suffix arrays; add() scans a new batch against all of them, then merges equal sizes.

    Entries have a key, a context and more columns. Of entries of a batch that are equal in both one is kept.
    """

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, context: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Indices of the entries that are not kept, as an equal one is."""
        if not len(key):
            return np.zeros(0, np.int64)
        order = np.lexsort((context, key))
        first = _first_of_equals(key[order], context[order])
        some = order[first]
        again = np.add.reduceat(~first, np.flatnonzero(first)) > 0
        new = Level(data, start[some], size[some], again, [c[some] for c in (key, context, *more)])
        for level in self.levels:
            level.scan(new)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return order[~first]

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def take(self) -> list[np.ndarray]:
        """again, key, context and the other columns of all entries by (key, context), and an empty family."""
        if not self.levels:
            return []
        again = np.concatenate([x.again for x in self.levels])
        cols = [np.concatenate(c) for c in zip(*(x.payload for x in self.levels), strict=True)]
        self.levels = []
        order = np.lexsort((cols[1], cols[0]))
        again, *cols = (c[order] for c in (again, *cols))
        same = ~_first_of_equals(*cols[:2])
        again |= same | np.r_[same[1:], False]
        return [again, *cols]


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """row, anchor fingerprint, context fingerprint, first and last window start and place (within the row) of all anchors."""
    k = length // 2
    w = length - k + 1
    limit = int(_PLACE) - length
    if offs[-1] > limit:  # rows in groups that fit, long ones in fragments that overlap by length - 1 bytes
        parts, at = [], 0
        while at < len(offs) - 1:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            size = int(offs[to] - offs[at])
            step = limit - length
            for cut in range(0, max(size - length, 0) + 1, step) if to == at + 1 and size > limit else [0]:
                end = min(size, cut + step + length - 1) if to == at + 1 and size > limit else size
                own = np.array([0, end - cut]) if to == at + 1 else offs[at : to + 1] - offs[at]
                got = anchors(data[offs[at] + cut : offs[at] + end], own, length)
                parts.append((got[0] + at, got[1], got[2], got[3] + cut, got[4] + cut, got[5] + cut))
            at = to
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    n = len(data)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = np.diff(offs)
    if n < length or sizes.max() < length:
        return empty
    p = tx.block_prefix(data)
    grams = tx.mix((p[k - 7 : n - 6] - p[: n - k + 1]) * tx.powers(n + 1, True)[: n - k + 1])
    x = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(x) % w
    blocks = np.r_[x, np.full(pad, np.uint64(2**64 - 1))].reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & _PLACE
    inside = np.zeros(n + 2, np.int32)
    long = sizes >= length
    np.add.at(inside, offs[:-1][long], 1)
    np.add.at(inside, offs[1:][long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[:starts]) > 0)
    m = least[s].astype(np.int64)
    # the windows of an anchor are neighbours; those of another row have other anchors
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    lo, hi, at = s[first], s[np.r_[first[1:], len(s)] - 1], m[first]
    row = np.searchsorted(offs, lo, "right") - 1
    context = tx.span_hash(p, lo, hi + length) ^ (at - lo).astype(np.uint64)
    return row, grams[at], context, lo - offs[row], hi - offs[row], at - offs[row]


_ROWS = "key long, context long, id long, meta long, rel int"
_NAMES = ["key", "context", "id", "meta", "rel"]


def _batch(kind, key, context, ident, th, s, e, a) -> pa.RecordBatch:
    """Rows as they are shuffled: meta holds s, 24 bits of the row's text hash and the kind; rel holds a - s and e - s."""
    meta = (s.astype(np.int64) << 32) | (th.astype(np.int64) & 0xFFFFFF) << 8 | kind.astype(np.int64)
    rel = (np.clip(a - s, 0, 0x7FFF).astype(np.int32) << 16) | (e - s).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ident), pa.array(meta), pa.array(rel)], _NAMES)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """kind, key, context, id, th, s, e, a."""
    key, context, ident, meta, rel = (batch.column(c).to_numpy() for c in _NAMES)
    s = meta >> 32
    return (meta & 0xFF).astype(np.int8), key.view(np.uint64), context.view(np.uint64), ident, ((meta >> 8) & 0xFFFFFF).astype(np.int32), s.astype(np.int32), (s + (rel & 0xFFFF)).astype(np.int32), (s + (rel >> 16)).astype(np.int32)


def _chunks(*cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cols[0]), 100_000):
        yield _batch(*(c[i : i + 100_000] for c in cols))


def _first_of_equals(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])] if len(key) else np.zeros(0, bool)


def _settle(family: Family, edges: bool) -> Iterator[pa.RecordBatch]:
    """What a task says of its own entries: repeats, edges that need no further meeting, and one entry for each distinct context."""
    got = family.take()
    if not got:
        return
    met, key, context, ident, th, s, e, a, kind = got
    first = _first_of_equals(key, context)
    new_key = np.r_[True, key[1:] != key[:-1]]
    rank = np.cumsum(first)
    variant = rank - rank[np.flatnonzero(new_key)][np.cumsum(new_key) - 1]  # 0, 1, ... among the contexts of a key
    sent = first & (variant < VARIANTS) if edges else first
    # of equals that met, the one that goes on is repeated, and a witness for other tasks
    yield from _told(met & (kind != WITNESS), ident, th, s, e, a)
    yield from _chunks(*(c[sent] for c in (np.where(met, WITNESS, kind), key, context, ident, th, s, e, a)))
    if edges:  # a key with very many contexts here is known to be an edge
        more = first & ~sent
        zero = np.zeros(len(key), np.uint64)
        yield from _chunks(*(c[more] for c in (np.where(met, WITNESS, EDGE) + PASSED, tx.mix(ident.view(np.uint64)), zero, ident, th, s, e, a)))


def _told(which: np.ndarray, ident: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeats; rows that need not meet any more are dealt evenly."""
    zero = np.zeros(len(ident), np.uint64)
    yield from _chunks(*(c[which] for c in (np.full(len(ident), REPEATED), tx.mix(ident.view(np.uint64)), zero, ident, *rest)))


def _meet(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """The second step: entries of all tasks by (key, context). Gives repeats and, with ``edges``, what needs a closer look.

    Only the last run of equals is held from batch to batch, or two of its rows, as that says enough.
    """
    held: list[np.ndarray] | None = None
    before = None  # the key of the last run that was decided

    def decided(cols: list[np.ndarray], after) -> Iterator[pa.RecordBatch]:
        kind, key, context, ident, th, s, e, a = cols
        first = _first_of_equals(key, context)
        met = ~first | ~np.r_[first[1:], True]
        fresh = met & (kind != WITNESS)
        yield from _chunks(*(c[fresh] for c in (np.full(len(key), REPEATED), key, context, ident, th, s, e, a)))
        if edges:
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            variants = np.add.reduceat(first.astype(np.int64), begin)
            variants[0] += key[0] == before
            variants[-1] += key[-1] == after
            look = first & (np.repeat(variants, np.diff(np.r_[begin, len(key)])) > 1)
            yield from _chunks(*(c[look] for c in (np.where(met | (kind == WITNESS), WITNESS, EDGE), key, context, ident, th, s, e, a)))

    for batch in batches:
        cols = _unpacked(batch)
        known = (cols[0] == REPEATED) | (cols[0] > PASSED)
        if known.any():
            yield _batch(*(c[known] for c in (np.where(cols[0] > PASSED, cols[0] - PASSED, cols[0]), *cols[1:])))
        cols = [c[~known] for c in cols]
        if held is not None:
            cols = [np.r_[x, y] for x, y in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.flatnonzero(_first_of_equals(cols[1], cols[2]))[-1])
        if last:
            yield from decided([c[:last] for c in cols], cols[1][last])
            before = cols[1][last - 1]
        held = [c[last:] for c in cols]
        if len(held[0]) > 2:  # the first stands for its context, the last shows that it is not alone
            fresh = np.r_[False, held[0][1:-1] != WITNESS, False]
            yield from _chunks(*(c[fresh] for c in (np.full(len(fresh), REPEATED), *held[1:])))
            held = [c[[0, -1]] for c in held]
    if held is not None:
        yield from decided(held, None)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text, the named columns and the row key (id, th), which are never null; equal rows have equal keys and equal results.

    id is a 64-bit hash of doc_id and text, so rows with a null or the same doc_id and different texts stay apart.
    """
    th = F.hash(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).bitwiseAND(0xFFFFFF)
    return texts(docs, *more).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("id"), th.alias("th"))


def _met(rows: DataFrame, step, edges: bool) -> DataFrame:
    """kind, id, th, s, e, a of what the two steps say of the entries of ``rows``.

    ``step`` gives those of a batch: its bytes, where suffixes start and how long they are, key, context, id, th, s, e, a and kind.
    """

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        family = Family()
        for batch in batches:
            for piece in tx.pieces(batch, most=tx.PIECE_BYTES // 2):
                data, start, size, key, context, *more, kind = step(piece)
                again = family.add(data, start, size, key, context, *more, kind)
                again = again[kind[again] != WITNESS]
                yield from _told(np.ones(len(again), bool), *(c[again] for c in more))
                if len(family) > FLUSH:
                    yield from _settle(family, edges)
        yield from _settle(family, edges)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        yield from _meet(batches, edges)

    met = rows.mapInArrow(tx.trimmed(here), _ROWS).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "context").mapInArrow(tx.trimmed(meet), _ROWS)
    s = F.shiftright("meta", 32).cast("int")
    return met.select(
        F.col("meta").bitwiseAND(0xFF).cast("int").alias("kind"), "id", F.shiftright("meta", 8).bitwiseAND(0xFFFFFF).cast("int").alias("th"),
        s.alias("s"), (s + F.col("rel").bitwiseAND(0xFFFF)).alias("e"), (s + F.shiftright("rel", 16)).alias("a"),
    )


def marked(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Contexts that are repeated as a whole (window starts s to e), and edges whose windows are undecided."""

    def step(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, offs = tx.flat(piece.column("text"))
        row, key, context, lo, hi, at = anchors(data, offs, length)
        return data, offs[row] + lo, hi - lo + length, key, context, piece.column("id").to_numpy()[row], piece.column("th").to_numpy()[row], lo.astype(np.int32), hi.astype(np.int32), at.astype(np.int32), np.zeros(len(row), np.int8)

    return _met(docs.select("text", "id", "th"), step, True)


def looked_at(docs: DataFrame, marks: DataFrame, length: int, cell: int) -> DataFrame:
    """Repeats and remaining edges among the undecided windows of ``marks``, in cells of ``cell`` windows counted from the anchor."""
    edges = marks.where(F.col("kind") != REPEATED).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e", "a", "kind")).alias("edges"))

    def step(piece: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        data, offs = tx.flat(piece.column("text"))
        p = tx.block_prefix(data)
        lists = piece.column("edges")
        owner = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
        lo, hi, at, kind = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in ("s", "e", "a", "kind"))
        # cell c of an anchor has the windows that start between a - c * cell - cell + 1 and a - c * cell
        c0, c1 = (at - hi) // cell, (at - lo) // cell
        n = c1 - c0 + 1
        c = np.repeat(c0 - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        owner, lo, hi, at, kind = (np.repeat(x, n) for x in (owner, lo, hi, at, kind))
        last = at - c * cell
        s, e = np.maximum(lo, last - cell + 1), np.minimum(hi, last)
        once = np.unique(np.c_[owner, s, e, c], axis=0, return_index=True)[1]  # rows that repeat a key share their edges
        owner, s, e, last, kind = (x[once] for x in (owner, s, e, last, kind))
        at_doc = offs[owner]
        key = tx.span_hash(p, at_doc + last, at_doc + last - cell + 1 + length)
        context = tx.span_hash(p, at_doc + s, at_doc + e + length) ^ (last - s).astype(np.uint64)
        kind = np.where(kind == WITNESS, WITNESS, ENTRY).astype(np.int8)
        return data, at_doc + s, e - s + length, key, context, piece.column("id").to_numpy()[owner], piece.column("th").to_numpy()[owner], s.astype(np.int32), e.astype(np.int32), e.astype(np.int32), kind

    return _met(only(docs, edges.select("id"), "id").join(edges, ["id", "th"]).select("text", "id", "th", "edges"), step, cell > 1)


def spans(docs: DataFrame, length: int = LENGTH, cell: int = CELL) -> DataFrame:
    """id, th, s, e: byte ranges of the rows that repeated strings cover; they may overlap."""
    found = marks = written(marked(docs, length))
    for width in (cell, 1):
        marks = written(looked_at(docs, marks, length, width))
        found = found.unionByName(marks)
    return found.where(F.col("kind") == REPEATED).select("id", "th", "s", (F.col("e") + length).alias("e"))


def _edited(docs: DataFrame, length: int, columns: str, row, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, and ``columns`` as ``row`` gives them for the bytes of a text and the mask of removed ones."""
    types = dict(docs.dtypes)
    docs = keyed(docs, *keep)
    covered = written(spans(docs, length).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    schema = ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), columns])
    names = ["doc_id", *keep, *(f.split()[0] for f in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for batch in batches:
            for piece in tx.pieces(batch):
                data, offs = tx.flat(piece.column("text"))
                out = []
                for i, found in enumerate(piece.column("spans").to_pylist()):
                    own = data[offs[i] : offs[i + 1]]
                    step = np.zeros(len(own) + 1, np.int32)
                    if found:
                        se = np.array([(f["s"], f["e"]) for f in found])
                        np.add.at(step, se[:, 0], 1)
                        np.add.at(step, se[:, 1], -1)
                    out.append(row(own, np.cumsum(step[:-1]) > 0))
                cols = [pa.array(list(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("doc_id", *keep)), *cols], names)

    # texts without repeats, most of them, are not shuffled
    ids, cols = covered.select("id"), ["doc_id", *dict.fromkeys(["text", *keep])]
    touched = only(docs, ids, "id").join(covered, ["id", "th"], "left").select(*cols, "spans")
    rest = only(docs, ids, "id", other=True).select(*cols, F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans"))
    return touched.mapInArrow(tx.trimmed(run), schema).unionByName(rest.mapInArrow(tx.trimmed(run), schema))


def removal_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def row(data: np.ndarray, gone: np.ndarray):
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        return len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()

    return _edited(docs, length, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)


def without_repeats(docs: DataFrame, *keep: str, length: int = LENGTH) -> DataFrame:
    """doc_id, the columns ``keep`` and kept_text, n_removed of every row; bytes of characters that were cut through go from the text too."""

    def row(data: np.ndarray, gone: np.ndarray):
        return data[~gone].tobytes().decode("utf-8", "ignore"), int(gone.sum())

    return _edited(docs, length, "kept_text string, n_removed long", row, *keep)
