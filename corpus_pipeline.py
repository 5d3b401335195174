"""Documents to token ids in five stages, each on all that the one before kept.

quality classifier: documents that it rejects go. n-gram Jaccard join: of each group of
near duplicates the smallest id stays. suffix-array dedup: bytes of strings of 200 bytes
that repeat go from the texts. mixing sources to target weights: documents are dropped or
repeated so that sources have their target shares. BPE encoding and decoding: texts become
token ids, with a digest of what these decode to.

Defined results: null ids and texts take part, a null text as the empty one (what no
stage rejects leaves the third with an empty text); a score equal to the classifier's
threshold stays; of near duplicates the smallest id stays, with all rows that repeat it,
and so do rows without an id; null source is a source of its own; texts of any length are
taken whole; an empty table gives an empty result; other columns of documents, whatever
their names, go before the first stage.

Before each stage executors give back the heap that the one before left them, which
would else add to the memory of all that follow.

SQL can't express the trained classifier or the byte-level stages, so ORACLE_SQL is None
and tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraline.llm import bpe, mixing, quality, repeats, setjoin
from moraline.llm._spark import give_back, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return quality.keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return setjoin.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    kept = repeats.without_repeats(docs, "lang", "source")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    return bpe.encoded(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
