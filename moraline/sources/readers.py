"""Vocabulary tiers, sentence files and tables as DataFrames.

Vocabularies are parameters: CSV files with the columns of schemas.VOCABULARY, one for
each tier. ``load_seq`` numbers rows by tier and by line, so that later ones may win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kana
from ..operators import dictionary
from . import schemas


def vocabulary(spark: SparkSession, path: str, tier: int = 0) -> DataFrame:
    rows = spark.read.schema(schemas.VOCABULARY).option("header", True).csv(path)
    return rows.withColumn("load_seq", F.lit(tier).cast("long") * (1 << 40) + F.monotonically_increasing_id())


def vocabularies(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All tiers one after the other; repeated entries stay."""
    out = vocabulary(spark, paths[0], 0)
    for i, p in enumerate(paths[1:], 1):
        out = out.unionByName(vocabulary(spark, p, i))
    return out


def by_class(vocab: DataFrame, pos: str | None = None, category: str | None = None) -> DataFrame:
    out = vocab if pos is None else vocab.where(F.col("pos") == pos)
    return out if category is None else out.where(F.col("category") == category)


def class_counts(vocab: DataFrame, column: str = "pos") -> DataFrame:
    return vocab.groupBy(column).agg(F.count("*").alias("n"))


def tiers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return dictionary.tiered({t: vocabulary(spark, p, i) for i, (t, p) in enumerate(paths.items())})


def sentences(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """sid, category, words of a JSON-lines file: lines that can't be read, words that lack a field and sentences of fewer than two words go."""
    rows = spark.read.schema(schemas.SENTENCE).option("mode", "DROPMALFORMED").json(path)
    whole = F.filter("words", lambda w: w["surface"].isNotNull() & w["reading"].isNotNull() & w["hangul"].isNotNull())
    rows = rows.select(F.monotonically_increasing_id().alias("sid"), F.coalesce("category", F.lit("wikipedia")).alias("category"), whole.alias("words")).where(F.size("words") >= 2)
    return rows if most is None else rows.orderBy("sid").limit(most)


def surfaces(rows: DataFrame) -> DataFrame:
    return rows.withColumn("surfaces", F.transform("words", lambda w: w["surface"]))


def unique_words(rows: DataFrame) -> DataFrame:
    """surface, reading, hangul: the first reading of each surface in the order of sentences."""
    each = rows.select("sid", F.posexplode("words").alias("pos", "w")).select("sid", "pos", "w.surface", "w.reading", "w.hangul")
    return dictionary.first_wins(each, ["surface"], "sid", "pos").select("surface", "reading", "hangul")


def corpus_stats(rows: DataFrame) -> DataFrame:
    """sentences, tokens, surfaces: one row."""
    each = rows.select(F.size("words").alias("n"), F.transform("words", lambda w: w["surface"]).alias("s"))
    one = each.agg(F.count("*").alias("sentences"), F.sum("n").alias("tokens"))
    distinct = each.select(F.explode("s").alias("s")).agg(F.countDistinct("s").alias("surfaces"))
    return one.crossJoin(distinct)  # one row each


def category_stats(rows: DataFrame) -> DataFrame:
    """category, sentences: most frequent first."""
    return rows.groupBy("category").agg(F.count("*").alias("sentences")).orderBy(F.desc("sentences"), "category")


def with_hangul(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("hangul", kana.hangul("reading"))


def write_table(rows: DataFrame, path: str, keys: list[str] | None = None, seq: str | None = None) -> None:
    """A Parquet table with one row for each key, the last by ``seq``; all rows without keys."""
    (dictionary.last_wins(rows, keys, seq) if keys else rows).write.mode("overwrite").parquet(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], out: str) -> None:
    """Writes to ``out`` the table at ``path`` where ``rows`` replace rows of the same keys."""
    old = spark.read.parquet(path)
    old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows).write.mode("overwrite").parquet(out)


def embeddings(spark: SparkSession, path: str, words: DataFrame | None = None) -> DataFrame:
    """The vectors table, or the vectors of ``words`` by one join."""
    rows = spark.read.schema(schemas.EMBEDDING).parquet(path)
    return rows if words is None else rows.join(words.select("word").distinct(), "word")


def meta(rows: DataFrame) -> DataFrame:
    """key, value of a log (key, value, seq): the last of each key."""
    return dictionary.last_wins(rows, ["key"], "seq").select("key", "value")


PLATFORMS = ("macos", "windows", "web", "android", "linux", "ios")


def clicks(requests: DataFrame, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """Rows of a click table from requests (method, body, user_agent, referrer, at): posts only, unknown platforms named so, texts cut to 300 characters. Works on streams."""
    platform = F.get_json_object("body", "$.platform")
    return requests.where(F.col("method") == "POST").select(
        F.when(platform.isin(*platforms), platform).otherwise("unknown").alias("platform"), F.col("at").alias("clicked_at"), F.substring("user_agent", 1, 300).alias("user_agent"), F.substring("referrer", 1, 300).alias("referrer")
    )
