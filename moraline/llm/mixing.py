"""Mixing sources to target weights by Poisson replication.

A source with target share w of all characters and c characters of its own is repeated
w * total / c times in the mean. Each document draws its number of copies from a Poisson
distribution with that mean, by inverting it at a number hashed from seed and id, is
exploded by that number, and all copies are dealt to partitions and ordered within them
by another hash, which is a global shuffle. Draws don't depend on partitioning.

Without given weights, sources are weighted by the ``temperature``-th power of their
sizes, which lifts small ones. Defined results: null source is a source of its own
(shown as null); a source without characters or weight keeps no document; null ids draw
as the empty id; rows that repeat an id draw alike. Means above 200 are drawn as sums of
Poissons of equal mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh, partitions

SEED, TEMPERATURE, BROADCAST_SOURCES, SALT = 42, 0.5, 100_000, 64
TERMS = 40  # a mean is split in parts of at most 4, for which 40 terms leave less than 1e-25


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, as any SQL engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def poisson(mean: Column, u: Column, terms: int = TERMS) -> Column:
    """The smallest k with u < P(X <= k): terms are multiplied up, P(k) = P(k-1) * mean / k."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + F.when(u >= s["c"], 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, rate: mean repetitions; one row for each source."""
    size = docs.groupBy("source").agg(F.sum(F.length("text")).cast("double").alias("chars")).where("chars > 0")
    if weights is None:
        size = size.withColumn("weight", F.pow("chars", F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        size = size.join(given, "source", "left")
    whole = size.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))  # one row
    return size.where("weight > 0").crossJoin(F.broadcast(whole)).select("source", (F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The columns of ``docs``, and copy (from 0) and shuffle_key: every drawn copy of every row, in random order.

    Where ``docs`` has columns of these names, they stay and the new ones get underscores
    after theirs. The text moves once, in the shuffle. Rates reach the rows by a broadcast
    while there are at most BROADCAST_SOURCES sources, else by a join on salted sources.
    """
    known = rates(docs, weights, temperature).cache()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("source").alias("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident"))
    if known.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        with_rate = rows.join(F.broadcast(known), F.col("own").eqNullSafe(F.col("source")))
    else:
        salted = known.select("source", "rate", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("ident"), F.lit(SALT)).cast("int"))
        with_rate = dealt.join(salted, F.col("own").eqNullSafe(F.col("source")) & (F.col("part") == F.col("salt")))
    # a Poisson of a large mean is a sum of such with equal small means, each with a hash of its own
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / 4)).cast("int")
    draw = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, i: n + poisson(F.col("rate") / parts, uniform(F.lit(str(seed)), F.col("ident"), i.cast("string"))))
    drawn = with_rate.select("row", "ident", draw.alias("n")).where("n > 0")
    copies = drawn.select("row", "ident", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    keyed = copies.select("row", "copy", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), F.col("ident"), F.col("copy").cast("string")).cast("binary")).alias("shuffle_key"))
    dealt = keyed.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", *(F.col(c).alias(fresh(c, docs.columns)) for c in ("copy", "shuffle_key")))


def oracle(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """DuckDB SQL for mixed() over the table documents."""
    u = f"cast('0x' || substr(md5('{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || part), 1, 13) as bigint) / {16**13}.0"
    return f"""
WITH size AS (SELECT source, sum(length(text))::double AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 0),
rate AS (SELECT source, power(chars, {temperature}) / sum(power(chars, {temperature})) OVER () * sum(chars) OVER () / chars AS rate FROM size),
parts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate, greatest(1, ceil(r.rate / 4))::int AS parts
          FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source),
each AS (SELECT *, unnest(range(0, parts)) AS part FROM parts),
drawn AS (SELECT doc_id, text, lang, source, n_chars, rate / parts AS m, {u} AS u FROM each),
terms AS (SELECT doc_id, text, lang, source, n_chars, list_sum(list_transform(range(0, {TERMS}), lambda k: CASE WHEN u >= list_sum(list_transform(range(0, k + 1), lambda j: exp(-m) * power(m, j) / gamma(j + 1.0))) THEN 1 ELSE 0 END)) AS n FROM drawn),
total AS (SELECT doc_id, text, lang, source, n_chars, sum(n)::int AS n FROM terms GROUP BY ALL),
copies AS (SELECT *, unnest(range(0, n)) AS c FROM total WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, c::int AS copy, md5('{seed}s:' || coalesce(cast(doc_id as varchar), '') || ':' || c) AS shuffle_key FROM copies
"""
