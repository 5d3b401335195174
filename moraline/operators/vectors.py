"""Word vectors: cosine, centroids, context vectors, byte codec, training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

TINY = 1e-10
DIM, RATE, ROUNDS, CAP, EDGES = 64, 0.05, 50, 10.0, 2_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm vanishes."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n < TINY, 0.0).otherwise(dot(a, b) / n)


def centroids(rows: DataFrame, group: list[str], vector: str = "vector", weight: Column | None = None) -> DataFrame:
    """Weighted mean vectors by group; zeros where weights vanish. One aggregation by (group, place), whatever the group's size."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    each = rows.select(*group, w.alias("__w"), F.posexplode(vector).alias("__i", "__v"))
    mean = each.groupBy(*group, "__i").agg(F.when(F.abs(F.sum("__w")) < TINY, 0.0).otherwise(F.sum(F.col("__v").cast("double") * F.col("__w")) / F.sum("__w")).alias("__m"))
    return mean.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("vector"))


def context_vectors(contexts: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, vector of contexts (id, words): weights 1 / distance from the end by the words' own places; ids without any vector drop out."""
    each = contexts.select("id", F.size("words").alias("n"), F.posexplode("words").alias("i", "word")).join(vectors.select("word", "vector"), "word")
    out = centroids(each.withColumn("w", 1.0 / (F.col("n") - F.col("i"))), ["id"], weight=F.col("w"))
    return out.where(F.exists("vector", lambda v: F.abs(v) >= TINY))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """word, vector: the plain mean of the vectors of words in both tables, and the vector of words in one."""
    both = a.select("word", "vector").join(b.select("word", F.col("vector").alias("other")), "word", "full")
    mean = F.zip_with("vector", "other", lambda x, y: ((x + y) / 2).cast("float"))
    return both.select("word", F.when(F.col("vector").isNotNull() & F.col("other").isNotNull(), mean).otherwise(F.coalesce("vector", "other")).alias("vector"))


@F.pandas_udf(T.BinaryType())
def to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))


def start(n: int, dim: int) -> np.ndarray:
    """The fixed starting values, by word number and dimension."""
    i, d = np.arange(n)[:, None], np.arange(dim)[None, :]
    return (((i * 7919 + d * 104729 + 31) * 0.6180339887 % 1.0 - 0.5) * 0.1).astype(np.float32)


def descent(edges: pd.DataFrame, dim: int, rounds: int, rate: float) -> tuple[list[str], np.ndarray, list[float]]:
    """Words in order, their vectors (of length 1), and the mean weighted loss of each round; edges in the order of words."""
    edges = edges[(edges.a < edges.b) & (edges.x >= 0.01)].sort_values(["a", "b"])
    words = sorted(set(edges.a) | set(edges.b))
    number = {w: i for i, w in enumerate(words)}
    v, bias, losses = start(len(words), dim), np.zeros(len(words), np.float32), []
    a, b, x = edges.a.map(number).to_numpy(), edges.b.map(number).to_numpy(), edges.x.to_numpy()
    f, t = np.minimum(1.0, (x / CAP) ** 0.75).astype(np.float32), np.log(x).astype(np.float32)
    for _ in range(rounds):
        loss = 0.0
        for i, j, fi, ti in zip(a.tolist(), b.tolist(), f.tolist(), t.tolist(), strict=True):
            off = float(v[i] @ v[j]) + bias[i] + bias[j] - ti
            loss += float(fi * off * off)
            g = np.float32(2 * rate * fi * off)
            v[i], v[j] = v[i] - g * v[j], v[j] - g * v[i]
            bias[i] -= g
            bias[j] -= g
        losses.append(loss / max(len(edges), 1))
    return words, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), TINY), losses


def in_one_task(edges: DataFrame, run, schema: str) -> DataFrame:
    """Descent is sequential by its definition, so all edges meet in one task, after a check of their number."""
    one = edges.select("a", "b", F.col("x").cast("double").alias("x"))
    if one.limit(EDGES + 1).count() > EDGES:
        raise ValueError(f"more than {EDGES} edges are not trained in one task; use factorised")
    return one.groupBy(F.lit(0).alias("g")).applyInPandas(lambda key, pdf: run(pdf), schema)


def trained(edges: DataFrame, dim: int = DIM, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """word, vector (of length 1): log-weights of edges factorised by stochastic descent in a fixed order of edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, v, _ = descent(pdf, dim, rounds, rate)
        return pd.DataFrame({"word": words, "vector": list(v)})

    return in_one_task(edges, run, "word string, vector array<float>")


def training_loss(edges: DataFrame, dim: int = DIM, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """round (from 1), loss: the mean loss over all edges while trained() goes on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        losses = descent(pdf, dim, rounds, rate)[2]
        return pd.DataFrame({"round": range(1, len(losses) + 1), "loss": losses})

    return in_one_task(edges, run, "round int, loss double")


def numbered(words: DataFrame) -> DataFrame:
    """word, id: distinct words numbered from 0 on without gaps, by ranges of words; the driver sees one number for each range."""
    ranged = words.select("word").distinct().repartitionByRange("word").sortWithinPartitions("word")
    rows = written(ranged.select("word", F.monotonically_increasing_id().alias("m"))).withColumn("part", F.shiftright("m", 33))
    sizes = rows.groupBy("part").count().orderBy("part").collect()
    upto = np.cumsum([0] + [r["count"] for r in sizes]).tolist()
    if upto[-1] >= 2**31:
        raise ValueError("factors have 32-bit ids")
    offsets = words.sparkSession.createDataFrame([(r.part, o) for r, o in zip(sizes, upto, strict=False)], "part long, offset long")
    return rows.join(F.broadcast(offsets), "part").select("word", (F.col("offset") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))


def factorised(edges: DataFrame, dim: int = DIM, rounds: int = 10) -> DataFrame:
    """word, vector: the distributed choice, alternating least squares on log(1 + weight); another algorithm than trained()."""
    from pyspark.ml.recommendation import ALS

    both = edges.select("a", "b", "x").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "x"))  # every word has neighbours
    ids = numbered(both.select(F.col("a").alias("word")))
    e = both.join(ids.select(F.col("word").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("word").alias("b"), F.col("id").alias("ib")), "b")
    model = ALS(rank=dim, maxIter=rounds, userCol="ia", itemCol="ib", ratingCol="r", seed=7).fit(e.select("ia", "ib", F.log1p("x").cast("float").alias("r")))
    return ids.join(model.userFactors, "id").select("word", F.col("features").alias("vector"))
