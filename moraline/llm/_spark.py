"""What the operators share on the driver: sizes, names, counts of frequent items."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import drop, remove, scratch_dir  # noqa: F401
from . import _text as tx


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shared: weakref.WeakSet[Broadcast] = weakref.WeakSet()


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that executors drop when the next table is written; who needs it later fetches it again."""
    out = spark.sparkContext.broadcast(value)
    _shared.add(out)
    return out


def written(df: DataFrame) -> DataFrame:
    """scratch.written(), after which executors give up what was shared for it."""
    out = scratch.written(df)
    for sent in list(_shared):
        sent.unpersist()
    return out


def give_back(spark: SparkSession) -> None:
    """Calls the collectors of the driver and of the executors.

    An executor's heap grows with what finished tasks have left, up to its limit, and gives
    nothing back to the system until its own collector is called, which takes a task there.
    Four for each executor are dealt out evenly while all are idle, and a later call finds what
    the first could not free yet; an executor that gets none only stays as it is.
    """
    sc = spark.sparkContext
    sc._jvm.System.gc()
    tasks = 4 * (sc._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    if tasks:
        spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def fresh(name: str, taken: list[str]) -> str:
    """The name, or with underscores after it where a column has it already."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, so that scans are pruned and clashing extra columns can't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def crc(column: str = "doc_id"):
    """crc32 of an id as text, as the folds of labelled rows use it; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


Items = Callable[[pa.RecordBatch], tuple[np.ndarray, int]]


def often(rows: DataFrame, items: Items, share: float, local: float = 0.25, least: int = 1, floor: int = 1) -> tuple[np.ndarray, int]:
    """A sorted list with all items whose count reaches max(least, share * total), and the total; one scan.

    Each task keeps the items that have ``local`` of the share there. What an item loses by
    that is under ``local`` of the bound, so those whose kept counts sum to the rest of it
    include all that are wanted. They are at most (items per total) / ((1 - local) * share),
    however large the input is, so the list may be broadcast. With ``floor`` 2 what a task
    sees once doesn't count there, which spares a shuffle of nearly all items where tasks
    are small; the list may then lack items that many tasks have once each.
    """

    def kept_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = tx.Counts(), 0
        for batch in batches:
            for piece in tx.pieces(batch):
                keys, n = items(piece)
                counts.add(keys)
                total += n
            if counts.full():  # a very large task counts as several
                yield from candidates(*counts.flush(), total)
                total = 0
        yield from candidates(*counts.flush(), total)

    def candidates(keys: np.ndarray, n: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["item", "n"])
        keep = n >= max(floor, local * share * total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(n[keep])], ["item", "n"])

    seen = written(rows.mapInArrow(tx.trimmed(kept_here), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")))
    total = int((seen.where("item is null").agg(F.sum("n")).first() or [0])[0] or 0)
    some = max((1 - local) * share * total, (1 - local) * least)
    return np.sort(_longs(seen.where(F.col("item").isNotNull() & (F.col("n") >= some)).select("item"))), total


def frequent(rows: DataFrame, items: Items, part: float, least: int = 1, local: float = 0.25) -> tuple[np.ndarray, np.ndarray, int]:
    """All 64-bit items whose count is at least max(least, part * total), their exact counts, and the total.

    ``items`` maps a piece of rows to (items with repeats, by how much the total grows).
    A first scan lists all that may be (see often), a second one counts exactly those, so
    what is broadcast and what is returned have a proven bound.
    """
    spark = rows.sparkSession
    cand, total = often(rows, items, part, local)
    bound = max(least, int(np.ceil(part * total)))
    if not len(cand):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), total
    wanted = share(spark, cand)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        n = np.zeros(len(keys), np.int64)
        for batch in batches:
            for piece in tx.pieces(batch):
                at = tx.found(keys, items(piece)[0])
                n += np.bincount(at[at >= 0], minlength=len(keys))
        some = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], ["item", "n"])

    kept = rows.mapInArrow(tx.trimmed(exact), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).toArrow()
    keys = kept.column("item").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], kept.column("n").to_numpy()[order], total


def _longs(df: DataFrame) -> np.ndarray:
    return df.toArrow().column(0).to_numpy().view(np.uint64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int) -> DataFrame:
    """doc_id, text and label of at most ``limit`` labelled rows outside the held-out fold.

    The rows with the smallest hashes of their ids are taken, so the sample does not
    depend on how tables are laid out. Ids without a label of 0 or 1 take no part; of
    several labels for an id the larger counts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.pmod(crc(), F.lit(folds)) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")


FILTER_BITS = 1 << 26


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) in which the bit of every id of the one column is set, for passes()."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bit(batch.column(0).to_numpy()))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    got = ids.mapInArrow(tx.trimmed(bits), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _bit(ids: np.ndarray) -> np.ndarray:
    return (tx.mix(ids.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def passes(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False where an id was surely not among those of the filter."""
    at = _bit(ids)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def only(rows: DataFrame, ids: DataFrame, column: str, other: bool = False) -> DataFrame:
    """The rows whose id (a long that is never null) may be among the one column of ``ids``, or all others; no shuffle.

    Whoever passes by chance must not matter: join what may be among them exactly.
    """
    bitmap = share(rows.sparkSession, id_filter(ids))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):  # small copies
                part = batch.slice(i, 1000)
                yield part.filter(pa.array(passes(bitmap.value, part.column(column).to_numpy()) != other))
            tx.release()

    return rows.mapInArrow(tx.trimmed(run), schema)
