"""Token counts of documents in flat, unindexed token files, by a separator scan.

A file is nothing but little-endian ids; each document ends with an end-of-document id.
Blocks of a fixed number of ids are read on their own and searched for the separator in
one vectorised comparison. A block tells how many it holds and where its last one is;
a prefix scan over these, in two levels so that no single task sees all blocks of a large
file, gives each block the ordinal of its first document and where that one began, which
stitches documents across block borders.

Defined results: a last document without separator counts if it has ids; an empty file
has no documents; a document may have no ids. ``write`` puts an empty text for null.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import partitions, remove, scratch_dir, texts, written

BLOCK_IDS, SUPER, EOD = 2 << 20, 1024, 50256


def tokenizer(path: str | None = None):
    import public_tokenizers as vocabularies
    import tiktoken

    with open(path or vocabularies.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, folder: str, path: str | None = None, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """Writes one flat file for each task below ``folder`` (a URI) and returns file, ordinal, doc_id of what it holds.

    A task that is run again writes another file; only files in the returned table count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, name, n = tokenizer(path), f"{folder}/{uuid.uuid4().hex}.bin", 0
        system, place = _filesystem(name)
        stream = None
        for batch in batches:
            for piece in tx.pieces(batch):
                if stream is None:
                    stream = system.open_output_stream(place)
                for t in piece.column("text").to_pylist():
                    stream.write(np.array([*coder.encode_ordinary(t or ""), eod], dtype).tobytes())
                m = piece.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.arange(n, n + m)), piece.column("doc_id")], ["file", "ordinal", "doc_id"])
                n += m
        if stream is not None:
            stream.close()

    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at)
    folder = re.sub(r"^file:/+", "file:///", system.makeQualified(at).toString())  # without a scheme the cluster's own file system is meant
    return written(texts(docs).mapInArrow(tx.trimmed(run), "file string, ordinal long, doc_id long"))


def blocks(spark: SparkSession, files: DataFrame, eod: int = EOD, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """file, block, n, last, ends: separators of each block of the files of column ``file``; positions are in ids from the file's start."""
    width = np.dtype(dtype).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            ids = [system.get_file_info(place).size // width for system, place in map(_filesystem, names)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64())], ["file", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, total, b in zip(batch.column("file").to_pylist(), batch.column("ids").to_pylist(), batch.column("block").to_pylist(), strict=True):
                system, place = _filesystem(name)
                start, stop = b * block_ids, min((b + 1) * block_ids, total)
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at((stop - start) * width, start * width), dtype)
                ends = np.flatnonzero(ids == eod) + start
                if stop == total and len(ids) and ids[-1] != eod:
                    ends = np.r_[ends, total]  # the end of the file stands for a missing separator
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([b], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "last", "ends"],
                )

    known = files.select("file").distinct().mapInArrow(tx.trimmed(sizes), "file string, ids long").where("ids > 0")
    each = known.select("file", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ids - 1) div {block_ids}"))).alias("block"))
    return each.repartition(partitions(spark), "file", "block").mapInArrow(tx.trimmed(scan), "file string, block long, n long, last long, ends array<long>")


def counts(spark: SparkSession, files: DataFrame, **options) -> DataFrame:
    """file, ordinal, start, n_tokens of every document in the files, which are read when this is called."""
    found = written(blocks(spark, files, **options))
    one = found.select("file", "block", "n", "last", F.expr(f"block div {SUPER}").alias("super"))
    inside = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    large = one.groupBy("file", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    large = large.select("file", "super", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n0"), F.max("last").over(across).alias("last0"))
    small = one.select("file", "super", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.max("last").over(inside).alias("last1"))
    carried = small.join(large, ["file", "super"]).select("file", "block", (F.col("n0") + F.col("n1")).alias("base"), F.coalesce("last1", "last0", F.lit(-1)).alias("before"))
    each = found.where("n > 0").join(carried, ["file", "block"]).select("file", "base", "before", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return each.select("file", (F.col("base") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def document_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document, counted in flat files that are written for it and go when they are scanned."""
    spark = docs.sparkSession
    folder = scratch_dir(spark) + "-flat"
    held = write(docs, folder, path)
    counted = counts(spark, held)
    remove(spark, folder)
    return held.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
