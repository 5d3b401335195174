"""Ranking candidates by reading, context, frequency and n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dictionary, vectors

WEIGHTS, WEIGHTS4, MAX_FREQUENCY, WINDOW_SIZE, PER_READING = (0.3, 0.5, 0.2), (0.1, 0.35, 0.25, 0.3), 10_000, 9, 5


def context_score(found: DataFrame, contexts: DataFrame, words: DataFrame, key: str = "surface", name: str = "context_score") -> DataFrame:
    """(1 + cosine with the context's vector) / 2; 0.5 where either is missing."""
    ctx = vectors.context_vectors(contexts, words).select("id", F.col("vector").alias("__ctx"))
    own = words.select(F.col("word").alias(key), F.col("vector").alias("__own"))
    out = found.join(ctx, "id", "left").join(own, key, "left")
    return out.withColumn(name, F.coalesce((vectors.cosine(F.col("__own"), F.col("__ctx")) + 1) / 2, F.lit(0.5))).drop("__ctx", "__own")


def ordered(found: DataFrame, score: Column) -> DataFrame:
    """Ranks by score, ties by surface and reading; of neighbours with one surface the first stays."""
    scored = found.withColumn("score", score)
    order = [F.desc("score"), F.col("surface"), F.col("hira")]
    kept = dictionary.consecutive_distinct(scored, ["id"], order, "surface")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))


def ranked(candidates: DataFrame, entries: DataFrame, contexts: DataFrame, words: DataFrame, max_frequency: int = MAX_FREQUENCY, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """id, hira, surface, conf, context_score, score, rank of candidates (id, hira, conf) with contexts (id, words)."""
    found = context_score(dictionary.with_self(candidates.select("id", "hira", "conf"), entries), contexts, words)
    a, b, c = weights
    return ordered(found, a * F.col("conf") + b * F.col("context_score") + c * F.col("frequency") / max(max_frequency, 1))


def ranked_readings(candidates: DataFrame, contexts: DataFrame, words: DataFrame) -> DataFrame:
    found = context_score(candidates.select("id", "hira", "conf").withColumn("surface", F.col("hira")), contexts, words)
    return ordered(found, 0.5 * F.col("conf") + 0.5 * F.col("context_score"))


def ranked_directional(candidates: DataFrame, entries: DataFrame, left: DataFrame, right: DataFrame, words: DataFrame, max_frequency: int = MAX_FREQUENCY, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Left contexts' forward vectors (F:word) against candidates' backward ones (B:word) and the other way round; both sides count 0.6 and 0.4."""
    side = lambda mark: words.where(F.col("word").startswith(mark)).select(F.substring("word", 3, 1 << 20).alias("word"), "vector")
    forward, backward = side("F:"), side("B:")
    found = dictionary.with_self(candidates.select("id", "hira", "conf"), entries)

    def against(found: DataFrame, contexts: DataFrame, of_context: DataFrame, of_candidate: DataFrame, name: str) -> DataFrame:
        ctx = vectors.context_vectors(contexts, of_context).select("id", F.col("vector").alias("__ctx"))
        out = found.join(ctx, "id", "left").join(of_candidate.select(F.col("word").alias("surface"), F.col("vector").alias("__own")), "surface", "left")
        return out.withColumn(name, (vectors.cosine(F.col("__own"), F.col("__ctx")) + 1) / 2).drop("__ctx", "__own")

    found = against(against(found, left, forward, backward, "l"), right, backward, forward, "r")
    both = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 0.6 * F.col("l") + 0.4 * F.col("r"))
    found = found.withColumn("context_score", F.coalesce(both, "l", "r", F.lit(0.5))).drop("l", "r")
    a, b, c = weights
    return ordered(found, a * F.col("conf") + b * F.col("context_score") + c * F.col("frequency") / max(max_frequency, 1))


def ranked4(candidates: DataFrame, entries: DataFrame, contexts: DataFrame, words: DataFrame, model, weights: tuple[float, float, float, float] = WEIGHTS4) -> DataFrame:
    """Reading, context, frequency / 10000 and the normalised n-gram score; the first of each surface stays."""
    found = context_score(dictionary.with_self(candidates.select("id", "hira", "conf"), entries), contexts, words)
    last = contexts.select("id", F.get("words", F.size("words") - 2).alias("w2"), F.get("words", F.size("words") - 1).alias("w1"))
    keys = found.join(last, "id", "left").select("id", "surface", "w2", "w1", F.col("surface").alias("word")).distinct()
    norm = model.scored(keys).select("id", "surface", "norm_score")
    found = found.join(norm, ["id", "surface"], "left")
    a, b, c, d = weights
    score = reduce(Column.__add__, [a * F.col("conf"), b * F.col("context_score"), c * F.col("frequency") / MAX_FREQUENCY, d * F.coalesce("norm_score", F.lit(0.0))])
    best = dictionary.first_wins(found.withColumns({"score": score, "neg": -score}), ["id", "surface"], "neg", "hira").drop("neg")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "surface", "hira")))


def converted(candidates: DataFrame, entries: DataFrame, max_frequency: int = MAX_FREQUENCY) -> DataFrame:
    """The candidate window: five entries of each reading at conf * min(frequency / max, 1), readings themselves at half conf, nine in all."""
    e = dictionary.top(entries.select(F.col("reading").alias("hira"), "surface", "frequency"), ["hira"], [F.desc("frequency"), F.col("surface")], PER_READING, "place")
    with_entry = candidates.join(e, "hira").select("id", "hira", "surface", (F.col("conf") * F.least(F.col("frequency") / max_frequency, F.lit(1.0))).alias("score"))
    own = candidates.select("id", "hira", F.col("hira").alias("surface"), (F.col("conf") * 0.5).alias("score"))
    return ordered(with_entry.unionByName(own), F.col("score")).where(F.col("rank") <= WINDOW_SIZE)
