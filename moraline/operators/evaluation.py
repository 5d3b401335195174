"""Accuracy, keystrokes, failures and long vowels as aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kana


def share(hit: Column) -> Column:
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def accuracy(ranks: DataFrame, group: list[str] | None = None, sentence: str = "sid") -> DataFrame:
    """words, top1, top3, top5, top10 of rows with the gold answer's rank (null: not among them), and the share of whole sentences."""
    keys = group or []
    r = F.col("rank")
    by_sentence = ranks.groupBy(*keys, sentence).agg(
        F.count("*").alias("n"), *(F.sum(F.when(r <= k, 1).otherwise(0)).alias(f"h{k}") for k in (1, 3, 5, 10)), F.min(F.when(r == 1, 1).otherwise(0)).alias("whole")
    )
    n = F.sum("n")
    return by_sentence.groupBy(*keys).agg(n.alias("words"), *((F.sum(f"h{k}") / n).alias(f"top{k}") for k in (1, 3, 5, 10)), F.avg("whole").alias("sentences"))


def keystrokes(rows: DataFrame) -> DataFrame:
    """words, plain, used, saving, per_word; 0 where nothing was typed."""
    t = rows.agg(F.count("*").alias("words"), F.sum("plain").alias("plain"), F.sum("used").alias("used"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return t.withColumns({"saving": ratio(F.col("plain") - F.col("used"), F.col("plain")), "per_word": ratio(F.col("used"), F.col("words"))})


def histogram(rows: DataFrame, pattern: str, most: int = 30) -> DataFrame:
    return rows.groupBy(pattern).agg(F.count("*").alias("n")).orderBy(F.desc("n"), pattern).limit(most)


def by_category(ranks: DataFrame) -> DataFrame:
    """category, words, exact, sentences (all exact), largest first."""
    one = ranks.groupBy("category", "sid").agg(F.count("*").alias("n"), F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("x"))
    return one.groupBy("category").agg(F.sum("n").alias("words"), F.sum("x").alias("exact"), F.sum(F.when(F.col("n") == F.col("x"), 1).otherwise(0)).alias("sentences")).orderBy(F.desc("words"), "category")


@F.pandas_udf(T.ArrayType(T.StringType()))
def long_vowels(reading: pd.Series) -> pd.Series:
    return reading.map(lambda x: None if x is None else [p for _, p in kana.long_vowels(x)])


def long_vowel_patterns(words: DataFrame) -> DataFrame:
    return words.select(F.explode(long_vowels("reading")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def decoded(rows: DataFrame) -> DataFrame:
    """words, any, first: how often the candidates (array of structs with hira, likeliest first) have the reading at all, and as their first."""
    return rows.agg(F.count("*").alias("words"), share(F.exists("candidates", lambda c: c["hira"] == F.col("reading"))).alias("any"), share(F.get("candidates", F.lit(0))["hira"] == F.col("reading")).alias("first"))


def by_long_vowels(rows: DataFrame, arms: list[str]) -> DataFrame:
    """long, words, and for each arm its share of right words, of words (reading, a rank for each arm) with and without long vowels."""
    has = F.size(long_vowels("reading")) > 0
    return rows.groupBy(has.alias("long")).agg(F.count("*").alias("words"), *(share(F.col(a) == 1).alias(a) for a in arms))


def failing(rows: DataFrame, most: int = 10) -> DataFrame:
    """sid, original, hangul, restored of the first sentences with a wrong word, of words (sid, pos, surface, hangul, restored)."""
    wrong = rows.where(~F.col("surface").eqNullSafe(F.col("restored"))).select("sid").distinct().orderBy("sid").limit(most)
    words = rows.join(F.broadcast(wrong), "sid").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("pos", "surface", "hangul", "restored"))).alias("w"))
    text = lambda field, by: F.array_join(F.transform("w", lambda w: F.coalesce(w[field], F.lit(""))), by)
    return words.select("sid", text("surface", "").alias("original"), text("hangul", " ").alias("hangul"), text("restored", "").alias("restored")).orderBy("sid")
