"""The queries opN_<name> of the training-data operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import backoff, bpe, fingerprint, mixing, neighbours, quality, repeats, setjoin, tokenfiles, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbour_report(read(spark, sf_dir, "documents"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(read(spark, sf_dir, "documents"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.document_counts(read(spark, sf_dir, "documents"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op5_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.report(read(spark, sf_dir, "documents"))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(read(spark, sf_dir, "documents"))


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_imatch_fingerprint,
        op2_repeated_bytes,
        op3_separator_scan,
        op4_poisson_mix,
        op5_toxicity_grammar,
        op6_bpe_roundtrip,
        op7_backoff_lm,
        op8_quality_fm,
        op9_ngram_jaccard,
        op10_kmeans_tree,
    )
}
ORACLES: dict[str, str] = {"op4_poisson_mix": mixing.oracle()}
