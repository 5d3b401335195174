"""Co-occurrence weights of words within sentences and between neighbouring ones.

Pairs within a window are built inside the row from slices, so cost is words x window and
nothing is shuffled before the partial sums. Pairs of neighbouring sentences are an
equality join on the shifted sentence number. Weights are summed by pair with map-side
aggregation; matrices are edge tables (a, b, x).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROSS, LINK, FLOOR = 0.5, 2.0, 0.01


def window_pairs(sentences: DataFrame, window: int, words: str = "words") -> DataFrame:
    """u, v, d: words at most ``window`` places apart, u first. For each distance the array beside itself: slices and zips, which stay in generated code."""
    w, d, n = F.col(words), F.col("d"), F.greatest(F.size(words) - F.col("d"), F.lit(0))
    apart = sentences.where(F.size(words) > 1).select(w, F.explode(F.sequence(F.lit(1), F.least(F.lit(window), F.size(words) - 1))).alias("d"))
    beside = F.arrays_zip(F.slice(w, F.lit(1), n).alias("u"), F.slice(w, d + 1, n).alias("v"))
    return apart.select("d", F.explode(beside).alias("p")).select("p.u", "p.v", "d")


def pair_sums(sentences: DataFrame, window: int, weight: Callable[[Column], Column], words: str = "words") -> DataFrame:
    """u, v, x: the sums of a weight of the distance over all pairs of words (strings) in windows.

    Words are summed as 64-bit hashes, which is much less to shuffle, and written again at
    the end; should two words ever share a hash, the query fails.
    """
    names = sentences.select(F.explode(words).alias("word")).groupBy(F.xxhash64("word").alias("h")).agg(F.min("word").alias("word"), F.max("word").alias("other"))
    name = names.select("h", F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(F.raise_error(F.lit("two words with one hash"))).alias("word"))
    hashed = sentences.select(F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    sums = window_pairs(hashed, window).groupBy("u", "v").agg(F.sum(weight(F.col("d"))).alias("x"))
    out = sums.join(name.select(F.col("h").alias("u"), F.col("word").alias("__u")), "u").join(name.select(F.col("h").alias("v"), F.col("word").alias("__v")), "v")
    return out.select(F.col("__u").alias("u"), F.col("__v").alias("v"), "x")


def neighbour_pairs(sentences: DataFrame, reach: int = 1, weight: float = 1.0, words: str = "words", order: list[str] | None = None) -> DataFrame:
    """u, v, x for words of sentences at most ``reach`` apart (columns of ``order``: group keys, then the sentence number)."""
    *group, at = order or ["chunk", "sid"]
    a = sentences.select(*group, F.col(at).alias("__at"), F.col(words).alias("__a")).withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    a = a.withColumn("__to", F.col("__at") + F.col("__d")).drop("__at")
    b = sentences.select(*group, F.col(at).alias("__to"), F.col(words).alias("__b"))
    both = a.join(b, [*group, "__to"])
    x = lambda i, j: weight / F.col("__d") / (F.size("__a") - i + j + 1)
    each = F.flatten(F.transform("__a", lambda u, i: F.transform("__b", lambda v, j: F.struct(u.alias("u"), v.alias("v"), x(i, j).alias("x")))))
    return both.select(F.explode(each).alias("p")).select("p.*").where(F.col("x") >= FLOOR)


def four_ways(pairs: DataFrame, x: Column) -> DataFrame:
    """Edges of pairs of words with surface and reading: surfaces and readings 1x, each crossed half."""
    ways = F.array(
        *[F.struct(F.col(f"u.{a}").alias("a"), F.col(f"v.{b}").alias("b"), (x * f).alias("x")) for a, b, f in (("surface", "surface", 1.0), ("reading", "reading", 1.0), ("surface", "reading", CROSS), ("reading", "surface", CROSS))]
    )
    return pairs.select(F.explode(ways).alias("e")).select("e.*")


def links(sentences: DataFrame, words: str = "words") -> DataFrame:
    """Edges between the surface and the reading of each word where they differ."""
    w = sentences.select(F.explode(words).alias("w"))
    return w.where("w.surface <> w.reading").select(F.col("w.surface").alias("a"), F.col("w.reading").alias("b"), F.lit(LINK).alias("x"))


def summed(edges: DataFrame, symmetric: bool = True) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "x")) if symmetric else edges
    return both.groupBy("a", "b").agg(F.sum("x").alias("x"))


def matrix(sentences: DataFrame, window: int = 5, reach: int = 0, weight: float = 1.0, symmetric: bool = True) -> DataFrame:
    """The edge table of sentences whose words are structs of surface and reading."""
    edges = four_ways(window_pairs(sentences, window), 1.0 / F.col("d")).unionByName(links(sentences))
    if reach:
        edges = edges.unionByName(four_ways(neighbour_pairs(sentences, reach, weight), F.col("x")))
    return summed(edges, symmetric)


def directional(sentences: DataFrame, window: int = 5, compat: bool = True) -> tuple[DataFrame, DataFrame]:
    """Forward and backward matrices; compatible ones are symmetric, and so alike."""
    edges = four_ways(window_pairs(sentences, window), 1.0 / F.col("d"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "x")
    return summed(edges, compat), summed(back, compat)


def trainable(edges: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Each undirected edge once."""
    return edges.where((F.col("a") < F.col("b")) & (F.col("x") >= floor))
