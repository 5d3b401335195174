"""Exact Jaccard join of word n-gram sets by universe partitioning and the pigeonhole principle.

Two sets whose Jaccard likeness reaches t differ in at most H = (1-t)/(1+t) * (|X|+|Y|)
tokens. Tokens are hashed into segments, as many as the size band asks for; if segments of
X together grant more than H differences, one of them is within its grant in Y. Segments
of rare tokens come first and get grant 0 (an equal subset must be met), unusually full
ones grant 1 and index their one-deletion neighbourhoods as well, and segments of
frequent tokens are only drawn on when the rare ones don't suffice, which is what keeps
the cost of passages that many documents share low. A set indexes segments in this order
until their grants exceed H; of two sets the one that stops first has a match within what
the other has indexed too, so no link is lost.

Sets that are equal form one class. In a first round each class is compared with one
other of those it shares signatures with, the most central of their group, which joins
most copies to their original. Whatever shares a signature and is not yet in one component
is then held apart, where that can be, by two bounds that are never more than the number
of differing tokens: the difference of the distances to the same central class, and the
distance of histograms. What these can't tell apart is verified on whole sets. Groups of very many classes are
compared in pairs of blocks, each a task's worth. Tokens are 64-bit hashes of word n-grams.

Defined results: words are lower-cased (A-Z) runs outside white space; a text with fewer
than n words has its whole word sequence as single token; null and wordless texts have
no token and link with nothing; rows that repeat a doc_id count once for each different
text, and the id's component is the smallest id that any of them reaches. Null ids take
part as members but give no component id of their own (their component_id is the smallest
non-null one reachable, else null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import drop, id_filter, often, only, partitions, passes, share, texts, written

NGRAM, PERCENT, FREQUENT, FULL = 5, 80, 2.5e-4, 6


def shingles(piece: pa.RecordBatch, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct tokens of each row."""
    data, offs = tx.flat(piece.column("text"))
    _, _, h, first = tx.words(data, offs)
    salt = tx.seeds(n, 23) | np.uint64(1)
    gram = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        gram += tx.mix(h[k : k + len(gram)] ^ salt[k])
    gram = tx.mix(gram)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(tx.distinct(gram[a : b - n + 1]))
        elif b > a:
            out.append(tx.mix(np.array([sum(int(x) * int(salt[k]) for k, x in enumerate(h[a:b])) + b - a & (1 << 64) - 1], np.uint64)))
        else:
            out.append(h[:0])
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits for a set; the second half is never null for sets with tokens."""
    a = int(tokens.sum()) + len(tokens) * 0x9E3779B97F4A7C15
    b = int(tx.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())
    return tuple(int(np.array([x & (1 << 64) - 1], np.uint64).view(np.int64)[0]) for x in (a, b))


def band(size: int) -> int:
    """Sizes are banded by doubling: band b holds 2^b .. 2^(b+1)-1."""
    return size.bit_length() - 1


def differences(x: int, y: int, percent: int = PERCENT) -> int:
    return (x + y) * (100 - percent) // (100 + percent)


def segments(upper: int) -> int:
    """How many segments the universe has for sets below ``upper`` tokens; 0: every token is a segment."""
    return 0 if upper <= 128 else upper if upper <= 1024 else upper // 2


class Signer:
    def __init__(self, common: np.ndarray, percent: int = PERCENT):
        self.common, self.percent = common, percent

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The distinct 64-bit signatures of one set, for its own band and, if its largest partner is beyond, the next one."""
        n = len(tokens)
        most = 100 * n // self.percent
        own = band(n)
        rare = tx.found(self.common, tokens) < 0
        place, value = tx.mix(tokens ^ np.uint64(0x5BD1E995)), tx.mix(tokens)
        common = None if rare.all() else (~rare).astype(np.uint64) << np.uint64(63)
        out = [self.under(place, value, common, own, differences(n, min(most, (2 << own) - 1), self.percent))]
        if most >= 2 << own:
            out.append(self.under(place, value, common, own + 1, differences(n, most, self.percent)))
        return np.concatenate(out)

    def under(self, place: np.ndarray, value: np.ndarray, common: np.ndarray | None, scheme: int, most: int) -> np.ndarray:
        m = segments(2 << scheme)
        seg = place % np.uint64(m) if m else place >> np.uint64(1)
        if common is not None:
            seg = seg | common
        order = np.argsort(seg, kind="stable")
        seg, value = seg[order], value[order]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, len(seg)])
        grants = np.cumsum(np.where(size >= FULL, 2, 1))
        stop = int(np.searchsorted(grants, most + 1)) + 1  # all segments, if they should not suffice
        whole = np.add.reduceat(value, first)[:stop]
        first, size = first[:stop], size[:stop]
        tag = tx.mix(seg[first] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(scheme))
        sigs = [tx.mix(whole ^ tag)]
        for i in np.flatnonzero(size >= FULL):
            sigs.append(tx.mix((whole[i] - value[first[i] : first[i] + size[i]]) ^ tag[i]))
        return np.concatenate(sigs)


def _distinct(piece: pa.RecordBatch) -> tuple[np.ndarray, int]:
    sets = shingles(piece)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), piece.num_rows


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 of every row; equal sets have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.pieces(batch):
                sets = shingles(piece)
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["doc_id", "n_shingles", "k1", "k2"]
                )

    return docs.mapInArrow(tx.trimmed(run), "doc_id long, n_shingles long, k1 long, k2 long")


def shared_signatures(docs: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """sig, cls, n, size: the signatures that at least two classes have, ``size`` of them; cls is a class's k1, n how many tokens it has."""
    signer = share(docs.sparkSession, Signer(common))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        for batch in batches:
            for piece in tx.pieces(batch):
                sets = [s for s in shingles(piece) if len(s)]
                if not sets:
                    continue
                keys = [set_key(s)[0] for s in sets]
                _, once = np.unique(keys, return_index=True)
                sigs = [signer.value.of(sets[i]) for i in once]
                sizes = [len(s) for s in sigs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(sigs).view(np.int64)),
                        pa.array(np.repeat(np.array([keys[i] for i in once], np.int64), sizes)),
                        pa.array(np.repeat(np.array([len(sets[i]) for i in once], np.int32), sizes)),
                    ],
                    ["sig", "cls", "n"],
                )

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        got = [(b.column("sig").to_numpy(), b.column("cls").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        sig, cls, n = (np.concatenate(c) for c in zip(*got, strict=True))
        del got
        order = np.argsort(sig, kind="stable")
        sig, cls, n = sig[order], cls[order], n[order]
        new = np.r_[True, sig[1:] != sig[:-1]]
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(cls, first), np.maximum.reduceat(cls, first)
        keep = np.repeat(low != high, np.diff(np.r_[first, len(sig)]))
        sig, cls, n = sig[keep], cls[keep], n[keep]
        order = np.lexsort((cls, sig))
        sig, cls, n = sig[order], cls[order], n[order]
        once = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])] if len(sig) else np.zeros(0, bool)
        sig, cls, n = sig[once], cls[once], n[once]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(sig)])
        size = np.repeat(size, size).astype(np.int32)
        for i in range(0, len(sig), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 200_000]) for a in (sig, cls, n, size)], ["sig", "cls", "n", "size"])

    return docs.mapInArrow(tx.trimmed(sign), "sig long, cls long, n int").repartition(parts, "sig").mapInArrow(tx.trimmed(group), "sig long, cls long, n int, size int")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label: for every node of the edges (a, b) the smallest node reachable; other nodes are their own.

    Alternates hash-to-min over neighbours with pointer jumping, in tables of one row for
    each node or edge; long chains take logarithmically many rounds.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(now.withColumnsRenamed({"node": "b", "label": "low"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        step = now.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        # the label's own label: everybody jumps to where the node they point at points
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = not after.where("label <> old").isEmpty()
        now = after.select("node", "label")
        if not changed:
            return now


def verified(pairs: DataFrame, docs: DataFrame, summary: DataFrame, percent: int = PERCENT, block: int = 32) -> DataFrame:
    """a, b, apart, linked: the number of differing tokens of each pair of classes, and whether their sets reach the likeness.

    Sets are built from the texts of one document for each class, found by a bitmap of
    fixed size and an exact join, and travel to their pairs; the partners of a class are
    dealt in blocks, so one with very many is spread over tasks.
    """
    spark = docs.sparkSession
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    heads = dealt.select("a", "block").distinct().select(F.col("a").alias("k1"), "a", "block", F.lit(0).alias("side"))
    asked = heads.unionByName(dealt.select(F.col("b").alias("k1"), "a", "block", F.lit(1).alias("side")))
    asked = written(asked.join(_reps(summary), "k1"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        head, key = None, None
        for batch in batches:
            a, blk, side, b = (batch.column(c).to_pylist() for c in ("a", "block", "side", "k1"))
            lists = batch.column("tokens")
            offs, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            out = []
            for i in range(batch.num_rows):
                tokens = values[offs[i] : offs[i + 1]]
                if side[i] == 0:
                    head, key = np.sort(tokens), (a[i], blk[i])
                elif (a[i], blk[i]) == key:
                    at = np.searchsorted(head, tokens)
                    at[at == len(head)] = 0
                    both = int((head[at] == tokens).sum())
                    total = len(head) + len(tokens)
                    out.append((a[i], b[i], total - 2 * both, 100 * both >= percent * (total - both)))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "apart", "linked"])

    built = _built(docs, asked.select("rid"), "tokens array<long>", lambda sets: _lists(sets))
    rows = built.join(asked, ["rid", "k1"]).select("a", "block", "side", "k1", "tokens")
    return rows.repartition(partitions(spark), "a", "block").sortWithinPartitions("a", "block", "side").mapInArrow(tx.trimmed(compare), "a long, b long, apart long, linked boolean")


def _rid():
    """doc_id, or the smallest number for rows without."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _reps(summary: DataFrame) -> DataFrame:
    return summary.where("k1 is not null").groupBy("k1").agg(F.min(_rid()).alias("rid"))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offs = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(offs, (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))


def _built(docs: DataFrame, rids: DataFrame, column: str, make) -> DataFrame:
    """rid, k1 and what ``make`` gives for the sets of the documents whose rid may be among ``rids``."""
    bitmap = share(docs.sparkSession, id_filter(rids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(passes(bitmap.value, batch.column("rid").to_numpy()))
            for piece in tx.pieces(batch.filter(some)):
                got = shingles(piece)
                own = [i for i, s in enumerate(got) if len(s)]
                yield pa.RecordBatch.from_arrays([piece.column("rid").take(pa.array(own, pa.int64())), pa.array([set_key(got[i])[0] for i in own], pa.int64()), make([got[i] for i in own])], ["rid", "k1", column.split()[0]])

    return docs.select("text", _rid().alias("rid")).mapInArrow(tx.trimmed(run), f"rid long, k1 long, {column}")


def buckets(n: int) -> int:
    return 128 if n < 512 else 256 if n < 2048 else 1024


def histogram(tokens: np.ndarray) -> bytes:
    """How many tokens, 255 at most, fall into each of buckets(n) ranges of a hash."""
    s = buckets(len(tokens))
    at = (tx.mix(tokens ^ np.uint64(0x1F3D5B79)) >> np.uint64(54)).astype(np.int64) // (1024 // s)
    return np.minimum(np.bincount(at, minlength=s), 255).astype(np.uint8).tobytes()


def folded(hist: bytes, s: int) -> np.ndarray:
    """A histogram in s ranges, which are fewer or as many."""
    return np.minimum(np.frombuffer(hist, np.uint8).reshape(s, -1).sum(1, dtype=np.int16), 255)


def _by_group(batches: Iterator[pa.RecordBatch], group: str, *columns: str) -> tuple[list, np.ndarray] | None:
    """The columns of a whole partition by group, the most central classes first, and the groups' first places."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    cols = [t.column(c).to_numpy() for c in (group, *columns)]
    order = np.lexsort((t.column("cls").to_numpy(), -t.column("central").to_numpy(), cols[0]))
    cols = [c[order] for c in cols]
    return cols, np.r_[np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]), len(order)]


def one_each(live: DataFrame, percent: int) -> DataFrame:
    """a, b: for each class b that is not the most central one of all its groups, of those that are the one it shares most signatures with."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        got = _by_group(batches, "sig", "cls", "n")
        if got is None:
            return
        (sig, cls, n), first = got
        n = n.astype(np.int64)
        head = np.repeat(first[:-1], np.diff(first))
        fit = (head < np.arange(len(sig))) & (100 * np.minimum(n, n[head]) >= percent * np.maximum(n, n[head]))
        pair, votes = np.unique(np.c_[cls[fit], cls[head[fit]]], axis=0, return_counts=True)
        order = np.lexsort((pair[:, 1], -votes, pair[:, 0]))  # a task speaks for one other class only
        pair, votes = pair[order], votes[order]
        once = np.r_[True, pair[1:, 0] != pair[:-1, 0]] if len(pair) else np.zeros(0, bool)
        pair, votes = pair[once], votes[once]
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(votes)], ["b", "a", "votes"])

    votes = live.repartition(partitions(live.sparkSession), "sig").mapInArrow(tx.trimmed(propose), "b long, a long, votes long").groupBy("b", "a").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("votes", "a")).alias("a")).select("a", "b")


def described(live: DataFrame, docs: DataFrame, summary: DataFrame) -> DataFrame:
    """cls, n, central, hist: one row for each class."""
    nodes = live.groupBy("cls").agg(F.first("n").alias("n"), F.first("central").alias("central"))
    nodes = written(nodes.join(_reps(summary).withColumnRenamed("k1", "cls"), "cls"))
    hists = _built(docs, nodes.select("rid"), "hist binary", lambda sets: pa.array([histogram(s) for s in sets], pa.binary()))
    hists = hists.join(nodes.select("rid", F.col("cls").alias("k1")), ["rid", "k1"]).select(F.col("k1").alias("cls"), "hist")
    return written(nodes.drop("rid").join(hists, "cls").dropDuplicates(["cls"]))


def not_apart(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow the likeness."""
    of = lambda c: nodes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("hist").alias(f"h{c}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("na", "nb", "ha", "hb")]
            keep = []
            for na, nb, ha, hb in zip(*cols, strict=True):
                s = min(len(ha), len(hb))
                keep.append(int(np.abs(folded(ha, s) - folded(hb, s)).sum()) <= differences(na, nb, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(tx.trimmed(bound), "a long, b long")


def close_pairs(live: DataFrame, nodes: DataFrame, pivots: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """a, b: all pairs of classes of different components that share a signature and that the bounds don't hold apart.

    pivots: (cls, pivot, away; null where the distance is not known). Classes with one pivot
    meet once, in its group; groups of a signature are for classes with different ones.
    """
    spark = live.sparkSession
    labels = live.groupBy("cls").agg(F.first("label").alias("label"))
    away = F.when(F.col("pivot").isNull(), 0).otherwise(F.coalesce("away", F.lit(-1)))
    nodes = nodes.join(labels, "cls").join(pivots, "cls", "left").withColumn("away", away).withColumn("pivot", F.coalesce("pivot", "cls"))
    nodes = written(nodes)
    kept = ["cls", "n", "label", "central", "pivot", "away"]
    by_sig = live.select("sig", "cls").join(nodes.select("cls", "pivot", "label"), "cls")
    mixed = by_sig.groupBy("sig").agg(F.min("pivot").alias("p0"), F.max("pivot").alias("p1"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size"))
    mixed = mixed.where("p0 <> p1 and l0 <> l1").select(F.col("sig").alias("group"), "size", F.lit(1).alias("by"))
    family = nodes.groupBy("pivot").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size")).where("l0 <> l1")
    members = by_sig.select(F.col("sig").alias("group"), "cls").join(mixed, "group").unionByName(
        nodes.select(F.col("pivot").alias("group"), "cls").join(family.select(F.col("pivot").alias("group"), "size", F.lit(0).alias("by")), "group")
    )
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a block meets itself and every other one: pair (i, j) is with i on the left and j on the right
    cell = F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(i, j) as i, greatest(i, j) as j))"))
    dealt = own.select("group", "by", "cls", F.col("i").alias("mine"), cell.alias("cell")).select("group", "by", "cls", "mine", "cell.*")
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("i"), 0).otherwise(1)
    dealt = dealt.select(F.xxhash64("group", "by", "i", "j").alias("cell"), "by", "cls", side.alias("side"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.release()
        got = _by_group(batches, "cell", "cls", "n", "label", "side", "by", "hist", "pivot", "away")
        if got is None:
            return
        (_, cls, n, label, side, by, hist, pivot, away), first = got
        n = n.astype(np.int64)
        size = np.diff(first)
        level = np.where(n < 512, 128, np.where(n < 2048, 256, 1024))
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for s in (128, 256, 1024):
            rows = np.flatnonzero(level >= s)
            at = np.full(len(n), -1)
            at[rows] = np.arange(len(rows))
            tables[s] = at, np.array([folded(hist[r], s) for r in rows], np.int16).reshape(len(rows), s)
        for g in np.unique(size[size > 1]).tolist():
            left, right = np.triu_indices(g, 1)
            starts = first[:-1][size == g]
            step = max(1, 500_000 // len(left))
            for k in range(0, len(starts), step):
                base = starts[k : k + step, None]
                for c in range(0, len(left), 500_000):
                    i, j = (base + left[c : c + 500_000]).ravel(), (base + right[c : c + 500_000]).ravel()
                    fit = (label[i] != label[j]) & ((side[i] == 2) | (side[i] != side[j])) & ((by[i] == 0) | (pivot[i] != pivot[j]))
                    fit &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                    i, j = i[fit], j[fit]
                    most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
                    fit = (pivot[i] != pivot[j]) | (np.minimum(away[i], away[j]) < 0) | (np.abs(away[i] - away[j]) <= most)
                    i, j, most = i[fit], j[fit], most[fit]
                    for s, (at, table) in tables.items():  # each pair at the finest division that both have
                        own = np.flatnonzero(np.minimum(level[i], level[j]) == s)
                        for q in range(0, len(own), 20_000):
                            p = own[q : q + 20_000]
                            near = p[np.abs(table[at[i[p]]] - table[at[j[p]]]).sum(1, dtype=np.int64) <= most[p]]
                            out.append(np.c_[cls[i[near]], cls[j[near]]])
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.join(nodes.select(*kept, "hist"), "cls").repartition(partitions(spark), "cell").mapInArrow(tx.trimmed(hold), "a long, b long").distinct()


def class_components(docs: DataFrame, summary: DataFrame, percent: int = PERCENT, share: float = FREQUENT) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, label) of the classes that link with others, and verified links (a, b) that connect them; None without any."""
    spark = docs.sparkSession
    common = often(docs.select("text"), _distinct, share, local=0.75, least=8, floor=2)[0]
    shared = written(shared_signatures(docs.select("text"), common, 2 * partitions(spark)))  # a task holds its partition
    central = shared.groupBy("cls").agg(F.sum("size").alias("central"))
    live = written(shared.drop("size").join(central, "cls").withColumn("label", F.col("cls")))
    drop(shared)
    if live.isEmpty():
        return None, None
    nodes = described(live, docs, summary)
    first = written(one_each(live, percent))
    known = written(verified(written(not_apart(first, nodes, percent)), docs, summary, percent))
    links = known.where("linked").select("a", "b")
    labels = components(links)
    left = written(_relabelled(live, labels))
    drop(live)
    pivots = first.join(known.select("a", "b", "apart"), ["a", "b"], "left").select(F.col("b").alias("cls"), F.col("a").alias("pivot"), F.col("apart").alias("away"))
    rest = written(close_pairs(left, nodes, pivots, percent))
    drop(left, nodes)
    if not rest.isEmpty():
        links = written(links.union(verified(rest, docs, summary, percent).where("linked").select("a", "b")).distinct())
        labels = components(links)
    return labels, links


def _relabelled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """The groups that still hold classes of several components, with their labels."""
    now = live.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = now.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    return now.join(mixed, "sig", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = texts(docs)
    summary = written(summaries(docs))
    labels, _ = class_components(docs, summary, percent)
    keyed = summary if labels is None else summary.join(labels.withColumnRenamed("node", "k1"), "k1", "left")
    group = F.col("k1") if labels is None else F.coalesce("label", "k1")
    keyed = keyed.select("doc_id", "n_shingles", group.alias("group"))
    least = keyed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return keyed.join(least, "group", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their component.

    Rows that repeat that id stay together, and so do rows without id. Only rows whose id
    may be one of those dropped are shuffled.
    """
    dropped = written(near_duplicates(docs, percent).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct())
    rows = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    return only(rows, dropped, "__id", other=True).unionByName(only(rows, dropped, "__id").join(dropped, "__id", "left_anti")).select(*docs.columns)
