"""Scratch tables in the shared folder of ``spark.checkpoint.dir``: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# While a table is written: its shuffle files go at once, batches for Python workers stay small, and so do those read from Parquet:
# the array that holds a batch's texts, 10 MB and more by Spark's own 4096 rows, is allocated apart and makes executors' heaps grow.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.columnarReaderBatchSize": "64",
}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder; one of our own only where none is set and one machine is all there is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="moraline-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/moraline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table of the scratch folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = {key: spark.conf.get(key, None) for key in WHILE_WRITING}
    for key, value in WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    atexit.register(remove, spark, path)
    # Executors hold what was broadcast for finished jobs (a Hadoop configuration for each scan) until the driver's
    # collector finds it unreachable; Spark itself only calls that every half hour, and there are many jobs a minute here.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables that written() gave and that no later action reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the cluster's own cleaning of the folder remains
        pass
