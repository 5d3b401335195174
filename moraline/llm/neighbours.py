"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a sample of one vector in SHARE, so that it grows with the data,
but of FEWEST at least and MOST at most; every vector is then put into a leaf. A query
walks the tree through a priority queue that is ordered by the inner product with the
nodes' centres, and visits the first ``visits`` leaves it comes to. That number is widened,
by a tenth at a time, until a bounded sample of queries (``probes``) finds the wanted share
of its true neighbours, which an exact search over all vectors gives.
Leaves are dealt to parts in tree order by their counts, large ones to several, so parts
are equal whatever the leaves hold; a query goes once to each part that has a leaf it
visits. A task holds its part's vectors and streams the queries: scores are matrix
products, and those that may belong to the k largest are computed anew, exactly, in
double precision.

Defined results: null, empty and zero vectors, those with null or non-finite components
and those whose length is not the commonest one take no part; equal scores are ordered
by vec_id; rows that repeat a vec_id count once, with their best score, and ask once, with the
smallest of their vectors; null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import partitions, share, written

K, EVERY = 20, 20
SHARE, FEWEST, MOST, BRANCH, LEAF, PROBES, RECALL, WIDEN = 50, 20_000, 200_000, 32, 50, 200, 0.93, 1.1
PART, CELLS = 100_000, 4_000_000  # vectors of a task, and scores that it holds at once


@dataclass
class Node:
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None  # of the children
    leaf: int = -1


class Tree:
    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3):
        self.rng, self.branch, self.most, self.leaves = np.random.default_rng(seed), branch, leaf, 0
        self.root = self._grow(sample, sample.mean(0) if len(sample) else np.zeros(0), 0)

    def _grow(self, x: np.ndarray, centre: np.ndarray, depth: int) -> Node:
        node = Node(centre)
        groups = self._split(x) if len(x) > self.most and depth < 12 else []
        if len(groups) < 2:
            node.leaf, self.leaves = self.leaves, self.leaves + 1
        else:
            node.children = [self._grow(g, g.mean(0), depth + 1) for g in groups]
            node.centres = np.array([c.centre for c in node.children])
        return node

    def _split(self, x: np.ndarray, rounds: int = 8) -> list[np.ndarray]:
        """k-means with at most ``branch`` non-empty groups; equal vectors never part."""
        centres = np.unique(x[self.rng.permutation(len(x))[: 8 * self.branch]], axis=0)
        centres = centres[self.rng.permutation(len(centres))[: self.branch]]
        own = np.zeros(len(x), int)
        for _ in range(rounds):
            own = nearest(x, centres)
            used = np.unique(own)
            centres = np.array([x[own == c].mean(0) for c in used])
        own = nearest(x, centres)
        return [x[own == c] for c in np.unique(own)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the tree by the nearest centre."""
        out = np.empty(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.children:
                own = nearest(x[rows], node.centres)
                todo += [(c, rows[own == i]) for i, c in enumerate(node.children) if (own == i).any()]
            else:
                out[rows] = node.leaf
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue, n = [(0.0, 0, self.root)], 1
        while queue:
            _, _, node = heapq.heappop(queue)
            if not node.children:
                yield node.leaf
                continue
            for score, child in zip((node.centres @ q).tolist(), node.children, strict=True):
                heapq.heappush(queue, (-score, n, child))
                n += 1

    def first(self, q: np.ndarray, visits: int) -> list[int]:
        return [leaf for leaf, _ in zip(self.walk(q), range(visits), strict=False)]

    def enough(self, q: np.ndarray, visits: int, wanted: int, held: np.ndarray) -> list[int]:
        """The first leaves, and more until they hold as many vectors as wanted."""
        out, n = [], 0
        for leaf in self.walk(q):
            if len(out) >= visits and n >= wanted:
                break
            out.append(leaf)
            n += held[leaf]
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def largest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, scores: np.ndarray, own: int, k: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best of x for q, each id once; ``scores`` are close to exact, or -inf where x was not visited; ``distinct`` says that no id repeats."""
    some = np.flatnonzero((ids != own) & (scores > -np.inf))
    if distinct and len(some) > k:
        s = scores[some]
        bound = np.partition(s, len(s) - k)[len(s) - k]
        some = some[s >= bound - 1e-9 * (1 + abs(bound))]
    exact = (x[some] * q).sum(1)  # the same order of additions for every row, so equal vectors tie
    best = firsts(ids[some], exact, k)
    return some[best], exact[best]


def firsts(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, each id with its best score alone."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def repeats(ids: np.ndarray) -> bool:
    return len(np.unique(ids)) < len(ids)


def usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return rows.where((F.size("embedding") == (size.d if size else 0)) & whole)


def exact_search(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of a bounded list of queries among all rows; each task sends k for each query."""
    sent = share(rows.sparkSession, (np.array([i for i, _ in queries]), np.array([q for _, q in queries])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros((0, q.shape[1])))] * len(qi)
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))
            if len(ids):
                s, distinct = x @ q.T, not repeats(ids)
                for j in range(len(qi)):
                    got, _ = largest(ids, x, q[j], s[:, j], qi[j], k, distinct)
                    near_ids, near_x = np.r_[best[j][0], ids[got]], np.r_[best[j][1], x[got]]
                    keep = firsts(near_ids, (near_x * q[j]).sum(1), k)
                    best[j] = near_ids[keep], near_x[keep]
        out = [(qi[j], best[j][0], (best[j][1] * q[j]).sum(1)) for j in range(len(qi))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(i), a) for a, i, _ in out])), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], ["query_id", "vec_id", "score"]
        )

    return ranked(rows.mapInArrow(tx.trimmed(run), "query_id long, vec_id long, score double"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def calibrated(tree: Tree, rows: DataFrame, queries: DataFrame, k: int, recall: float, probes: int) -> int:
    """The number of leaf visits at which the probes find the wanted share of their true neighbours."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(probes).collect()
    some = list({r.vec_id: np.array(r.embedding) for r in some}.items())
    if not some:
        return 1
    truth = exact_search(rows, some, k).select("query_id", F.col("vec_id").alias("id"))
    near = truth.join(rows, truth.id == rows.vec_id).select("query_id", "embedding").toArrow().combine_chunks()
    leaf = tree.assign(matrix(near.column("embedding").combine_chunks() if near.num_rows else pa.array([], pa.list_(pa.float64())))) if near.num_rows else np.zeros(0, int)
    owner = near.column("query_id").to_numpy() if near.num_rows else np.zeros(0, int)
    place = np.empty(len(owner), int)
    for i, q in some:
        order = {x: n for n, x in enumerate(tree.walk(q))}
        mine = np.flatnonzero(owner == i)
        place[mine] = [order[x] for x in leaf[mine]]
    visits = 1
    while visits < tree.leaves and len(place) and (place < visits).mean() < recall:
        visits = int(np.ceil(visits * WIDEN))
    return min(visits, tree.leaves)


def search(vectors: DataFrame, every: int = EVERY, k: int = K, recall: float = RECALL, sample: int | None = None, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its k nearest of all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = sample or min(MOST, max(FEWEST, rows.count() // SHARE))
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).select("embedding").toArrow().combine_chunks()
    if not got.num_rows:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    tree = Tree(matrix(got.column("embedding").combine_chunks()))
    visits = calibrated(tree, rows, queries, k, recall, probes)
    sent = share(spark, tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.assign(matrix(batch.column("embedding"))))], [*batch.schema.names, "leaf"])

    placed = written(rows.mapInArrow(tx.trimmed(place), "vec_id long, embedding array<double>, leaf int"))
    held = placed.groupBy("leaf").count().collect()  # a row for each leaf of the bounded tree
    count = np.zeros(tree.leaves, np.int64)
    for r in held:
        count[r.leaf] = r["count"]
    own_ids = np.zeros(tree.leaves, np.int64)  # an id that repeats counts in one of its leaves
    for r in placed.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
        own_ids[r.leaf] = r["count"]
    parts = max(partitions(spark), -(-int(count.sum()) // PART))
    target = max(1, -(-int(count.sum()) // parts))
    upto = np.cumsum(count)
    base = np.minimum((upto - count) // target, parts - 1)
    spread = np.where(count > 0, np.minimum(np.maximum(upto - 1, 0) // target, parts - 1) - base + 1, 0)
    dealing = share(spark, (base, spread))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, spread = dealing.value
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            mixed = (batch.column("vec_id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = base[leaf] + (mixed % spread[leaf].astype(np.uint64)).astype(np.int64)
            yield _rows(part, 0, batch.column("vec_id"), batch.column("embedding"), pa.array([[x] for x in leaf.tolist()], pa.list_(pa.int32())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, spread = dealing.value
        for batch in batches:
            at, parts_, leaves = [], [], []
            for i, q in enumerate(matrix(batch.column("embedding"))):
                visited = np.array(sent.value.enough(q, visits, k + 1, own_ids))  # the query is one of the ids
                visited = visited[spread[visited] > 0]
                for part in np.unique(np.concatenate([np.arange(base[x], base[x] + spread[x]) for x in visited])) if len(visited) else []:
                    own = visited[(base[visited] <= part) & (part < base[visited] + spread[visited])]
                    at.append(i)
                    parts_.append(part)
                    leaves.append(own.tolist())
            rows_ = batch.take(pa.array(at, pa.int64()))
            yield _rows(np.array(parts_, np.int64), 1, rows_.column("vec_id"), rows_.column("embedding"), pa.array(leaves, pa.list_(pa.int32())))

    both = placed.mapInArrow(tx.trimmed(deal), _DEALT).unionByName(queries.mapInArrow(tx.trimmed(ask), _DEALT))
    both = both.repartitionById(parts, "part").sortWithinPartitions("part", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: list[pa.RecordBatch] = []
        ids, x, first, distinct = np.zeros(0, np.int64), np.zeros((0, 0)), {}, True
        for batch in batches:
            side = batch.column("side").to_numpy()
            if (side == 0).any():
                stored.append(batch.filter(pa.array(side == 0)))
            if not (side == 1).any():
                continue
            if stored:  # all vectors of the part came before its queries; they are put in the order of leaves
                t = pa.Table.from_batches(stored).combine_chunks()
                leaf = t.column("leaves").combine_chunks().flatten().to_numpy()
                order = np.argsort(leaf, kind="stable")
                ids, x = t.column("vec_id").to_numpy()[order], matrix(t.column("embedding").combine_chunks())[order]
                names, begin = np.unique(leaf[order], return_index=True)
                first = {int(n): (int(a), int(b)) for n, a, b in zip(names, begin, [*begin[1:], len(ids)], strict=True)}
                distinct, stored = not repeats(ids), []
            if not len(ids):
                continue
            asked = batch.filter(pa.array(side == 1))
            at_once = max(1, CELLS // len(ids))
            for start in range(0, asked.num_rows, at_once):
                some = asked.slice(start, at_once)
                qi, q = some.column("vec_id").to_numpy(), matrix(some.column("embedding"))
                visitors: dict[int, list[int]] = {}
                for j, own in enumerate(some.column("leaves").to_pylist()):
                    for n in own:
                        visitors.setdefault(n, []).append(j)
                scores = np.full((len(qi), len(ids)), -np.inf)
                for n, who in visitors.items():
                    if n in first:
                        a, b = first[n]
                        scores[who, a:b] = q[who] @ x[a:b].T
                out = []
                for j in range(len(qi)):
                    at, score = largest(ids, x, q[j], scores[j], qi[j], k, distinct)
                    out.append((np.full(len(at), qi[j]), ids[at], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return ranked(both.mapInArrow(tx.trimmed(compare), "query_id long, vec_id long, score double"), k)


_DEALT = "part int, side int, vec_id long, embedding array<double>, leaves array<int>"


def _rows(part: np.ndarray, side: int, ids: pa.Array, vectors: pa.Array, leaves: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), side, np.int32)), ids, vectors, leaves], ["part", "side", "vec_id", "embedding", "leaves"])
