"""Frequency dictionaries: tiers, lookups, prefixes, upserts, candidate joins, selection history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = {"core": 1000, "N5": 500, "N4": 300, "N3": 100}


def tiered(parts: dict[str, DataFrame], frequencies: dict[str, int] | None = None) -> DataFrame:
    """One table of all tiers, each with its frequency, in the order of the dict (load_tier); duplicates stay."""
    rank = frequencies or TIERS
    rows = [df.withColumns({"tier": F.lit(t), "frequency": F.lit(rank[t]).cast("long"), "load_tier": F.lit(i)}) for i, (t, df) in enumerate(parts.items())]
    return reduce(DataFrame.unionByName, rows)


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key: the one with the largest ``seq``. Aggregates before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def lookup(entries: DataFrame, reading: str, language: str | None = None) -> DataFrame:
    hit = F.col("reading") == reading
    return entries.where(hit if language is None else hit & (F.col("language") == language)).orderBy(F.desc("frequency"), "surface")


def by_prefix(entries: DataFrame, prefix: str, most: int = 20, column: str = "reading", strict: bool = False) -> DataFrame:
    """The ``most`` frequent entries that begin with ``prefix``; ``strict`` leaves out the prefix itself. A pushed-down filter and a top-k."""
    hit = F.col(column).startswith(prefix)
    if strict:
        hit &= F.length(column) > len(prefix)
    return entries.where(hit).orderBy(F.desc("frequency"), column, "surface").limit(most)


def with_self(candidates: DataFrame, entries: DataFrame, reading: str = "hira") -> DataFrame:
    """Candidates joined with their entries, and with themselves at frequency 0 unless an entry has the reading as surface."""
    e = entries.select(F.col("reading").alias(reading), "surface", "frequency")
    found = candidates.join(e, reading)
    bare = candidates.join(e.where(F.col(reading) == F.col("surface")).select(reading).distinct(), reading, "left_anti")
    own = bare.withColumns({"surface": F.col(reading), "frequency": F.lit(0).cast("long")})
    return found.unionByName(own.select(*found.columns))


def consecutive_distinct(rows: DataFrame, group: list[str], order: list[Column], key: str) -> DataFrame:
    """Rows whose key differs from the one before in the order of their group; a null key equals a null key."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = rows.withColumns({"__p": F.lag(key).over(w), "__n": F.row_number().over(w)})
    return before.where((F.col("__n") == 1) | ~F.col("__p").eqNullSafe(F.col(key))).drop("__p", "__n")


def top(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def selections(log: DataFrame) -> DataFrame:
    """input, selected, count, last_used of a selection log (input, selected, at); works on streams as well."""
    return log.groupBy("input", "selected").agg(F.count("*").alias("count"), F.max("at").alias("last_used"))


def unknown(tokens: DataFrame, known: DataFrame, column: str = "token") -> DataFrame:
    return tokens.join(known.select(column).distinct(), column, "left_anti")


def index(pairs: DataFrame, scale: int = 100) -> DataFrame:
    """hangul, reading, surface, frequency of aligned words (one row for each occurrence)."""
    return pairs.groupBy("hangul", "reading", "surface").agg((F.count("*") * scale).alias("frequency"))


def categories(entries: DataFrame) -> DataFrame:
    """category, entries: one row for each category with its entries; for templates over small vocabularies."""
    return entries.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("load_seq", "surface", "reading", "pos"))).alias("entries"))
