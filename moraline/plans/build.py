"""Building and keeping all models of a sentence table, and converting with them.

``build`` writes dictionary, index, token map, n-grams and vectors as Parquet below one
folder; each is one aggregation over the sentences. ``Converter`` answers batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccurrence, decode, dictionary, ngram, phonetic, ranking, vectors
from ..sources.scratch import written


@dataclass
class Config:
    """How models are built: ``scale`` multiplies frequencies, ``reach`` > 0 adds neighbouring sentences, ``longest`` and ``signs`` choose the token map."""

    window: int = 5
    reach: int = 0
    cross_weight: float = 1.0
    directional: bool = False
    dim: int = vectors.DIM
    rounds: int = vectors.ROUNDS
    scale: int = 1
    longest: int = 1
    signs: bool = False
    distributed_vectors: bool = False


def occurrences(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode("words").alias("w")).select("w.surface", "w.reading", "w.hangul")


def with_extras(counted: DataFrame, extras: DataFrame | None) -> DataFrame:
    """reading, surface, frequency, where extras replace what was counted."""
    if extras is None:
        return counted
    both = counted.withColumn("seq", F.lit(0)).unionByName(extras.select("reading", "surface", F.col("frequency").cast("long").alias("frequency")).withColumn("seq", F.lit(1)))
    return dictionary.last_wins(both, ["reading", "surface"], "seq").drop("seq")


def embeddings(sentences: DataFrame, c: Config) -> DataFrame:
    """word, vector; of directional ones F: and B: mark the two sides, and words of both have a plain mean as well."""
    learn = vectors.factorised if c.distributed_vectors else vectors.trained
    if not c.directional:
        return learn(written(cooccurrence.trainable(cooccurrence.matrix(sentences, c.window, c.reach, c.cross_weight))), c.dim, c.rounds)
    f, b = (learn(written(cooccurrence.trainable(e)), c.dim, c.rounds) for e in cooccurrence.directional(sentences, c.window))
    side = lambda df, mark: df.select(F.concat(F.lit(mark), "word").alias("word"), "vector")
    return side(f, "F:").unionByName(side(b, "B:")).unionByName(vectors.merged(f, b))


def build(sentences: DataFrame, path: str, config: Config | None = None, extras: DataFrame | None = None) -> dict[str, int]:
    """Writes the models and returns how large they are."""
    c = config or Config()
    words = occurrences(sentences)
    counted = words.groupBy("reading", "surface").agg((F.count("*") * c.scale).alias("frequency"))
    tables = {
        "entries": with_extras(counted, extras),
        "index": dictionary.index(words, c.scale),
        "map": phonetic.learned(phonetic.word_counts(words), c.longest, c.signs),
        "vectors": embeddings(sentences, c).withColumn("dim", F.size("vector")),
    }
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    ngram.NgramModel.build(sentences.select(F.transform("words", lambda w: w["surface"]).alias("words"))).save(f"{path}/ngrams")
    spark = sentences.sparkSession
    return {"sentences": sentences.count()} | {name: spark.read.parquet(f"{path}/{name}").count() for name in tables}


class Converter:
    """Batches of Hangul in kana and kanji, with models from build() or from vocabulary tiers."""

    def __init__(self, table: DataFrame, entries: DataFrame, max_frequency: int = ranking.MAX_FREQUENCY):
        self.table, self.entries, self.max_frequency = table.cache(), entries, max_frequency

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Converter:
        return cls(spark.read.parquet(f"{path}/map"), spark.read.parquet(f"{path}/entries"))

    @classmethod
    def of_vocabulary(cls, tiers: DataFrame, weight: int = 100) -> Converter:
        """tiers: surface, reading, hangul, frequency, load_seq; the last of repeated entries stays."""
        pairs = tiers.select("reading", "hangul", F.lit(weight).cast("long").alias("freq"))
        return cls(phonetic.learned(pairs), dictionary.last_wins(tiers.select("reading", "surface", "frequency", "load_seq"), ["reading", "surface"], "load_seq").drop("load_seq"))

    def convert(self, words: DataFrame) -> DataFrame:
        """id, hira, surface, score, rank of words (id, hangul): nine candidates at most."""
        found = decode.candidates(words, self.table, "hangul", 6, 10).select("id", F.explode("candidates").alias("c")).select("id", "c.hira", "c.conf")
        return ranking.converted(found, self.entries, self.max_frequency)

    def hiragana(self, rows: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
        """All columns and decoded, for whole sentences in the column hangul."""
        return decode.sentences(rows, self.table, "hangul", 4, 1, surfaces)

    def map_size(self) -> int:
        return self.table.select("token").distinct().count()
