"""Word n-grams with additive smoothing, interpolation and backoff; next-word prediction.

Sentences are rows with an array of words. Counts are three tables that stay distributed;
probabilities are left joins against them. Only totals (two numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.words import bound
from ..sources.scratch import written
from . import dictionary

BOS, K, LAMBDA = "<BOS>", 0.1, (0.4, 0.4, 0.2)  # weights of trigram, bigram, unigram


def spans(sentences: DataFrame, words: str = "words", bos: bool = True) -> DataFrame:
    """w2, w1, word for every place of every sentence (null before its start); built in the row, without a window or shuffle."""
    w = F.concat(F.array(F.lit(BOS)), F.col(words)) if bos else F.col(words)
    place = lambda w: F.transform(w, lambda x, i: F.struct(F.when(i > 1, F.get(w, i - 2)).alias("w2"), F.when(i > 0, F.get(w, i - 1)).alias("w1"), x.alias("word")))
    return sentences.select(F.explode(bound(w, place)).alias("s")).select("s.*")


def before(rows: DataFrame, group: list[str], order: list[str], word: str, most: int | None = None) -> DataFrame:
    """All columns and words: what comes before each row in its group, all of it or the last ``most``."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return rows.withColumn("words", F.collect_list(word).over(w))


def unigrams(s: DataFrame) -> DataFrame:
    return s.groupBy("word").agg(F.count("*").alias("count"))


def bigrams(s: DataFrame) -> DataFrame:
    return s.where("w1 is not null").groupBy(F.col("w1").alias("prev"), "word").agg(F.count("*").alias("count"))


def trigrams(s: DataFrame) -> DataFrame:
    return s.where("w2 is not null").groupBy(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "word").agg(F.count("*").alias("count"))


@dataclass
class NgramModel:
    uni: DataFrame
    bi: DataFrame
    tri: DataFrame
    total: int
    vocabulary: int
    k: float = K
    weights: tuple[float, float, float] = LAMBDA

    @classmethod
    def build(cls, sentences: DataFrame, words: str = "words", bos: bool = True, **options) -> NgramModel:
        """Sentences are read once: the counts are written, and every probability is a join with these tables."""
        s = spans(sentences, words, bos)
        grams = written(s.groupBy("w2", "w1", "word").agg(F.count("*").alias("count")))
        total = F.sum("count").alias("count")
        bi = written(grams.where("w1 is not null").groupBy(F.col("w1").alias("prev"), "word").agg(total))
        tri = grams.where("w2 is not null").select(F.col("w2").alias("w1"), F.col("w1").alias("w2"), "word", "count")
        return cls.of(written(grams.groupBy("word").agg(total)), bi, tri, **options)

    @classmethod
    def of(cls, uni: DataFrame, bi: DataFrame, tri: DataFrame, **options) -> NgramModel:
        size = uni.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        return cls(uni, bi, tri, int(size[0]), int(size[1]), **options)

    def merged(self, other: NgramModel) -> NgramModel:
        add = lambda a, b, *keys: a.unionByName(b).groupBy(*keys).agg(F.sum("count").alias("count"))
        return NgramModel.of(add(self.uni, other.uni, "word"), add(self.bi, other.bi, "prev", "word"), add(self.tri, other.tri, "w1", "w2", "word"), k=self.k, weights=self.weights)

    def save(self, path: str) -> None:
        for name in ("uni", "bi", "tri"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = [("total", str(self.total)), ("k", str(self.k)), *((f"weight{i}", str(x)) for i, x in enumerate(self.weights))]
        self.uni.sparkSession.createDataFrame(meta, "key string, value string").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NgramModel:
        meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
        out = cls.of(*(spark.read.parquet(f"{path}/{n}") for n in ("uni", "bi", "tri")), k=float(meta.get("k", K)), weights=tuple(float(meta.get(f"weight{i}", LAMBDA[i])) for i in range(3)))
        out.total = int(meta.get("total", 0))
        return out

    def counted(self, keys: DataFrame) -> DataFrame:
        """keys (w2, w1, word) with c1 (word), c2 (w1 word), c3 (w2 w1 word), h1 (w1), h2 (w2 w1); 0 where unseen."""
        out = keys.join(self.uni.withColumnRenamed("count", "c1"), "word", "left")
        out = out.join(self.uni.select(F.col("word").alias("w1"), F.col("count").alias("h1")), "w1", "left")
        out = out.join(self.bi.select(F.col("prev").alias("w1"), "word", F.col("count").alias("c2")), ["w1", "word"], "left")
        out = out.join(self.bi.select(F.col("prev").alias("w2"), F.col("word").alias("w1"), F.col("count").alias("h2")), ["w2", "w1"], "left")
        out = out.join(self.tri.select(F.col("w1").alias("w2"), F.col("w2").alias("w1"), "word", F.col("count").alias("c3")), ["w2", "w1", "word"], "left")
        return out.fillna(0, ["c1", "c2", "c3", "h1", "h2"])

    def p_unigram(self, of: Callable[[str], Column] = F.col) -> Column:
        return (of("c1") + self.k) / (self.total + self.k * self.vocabulary)

    def p_bigram(self, of: Callable[[str], Column] = F.col) -> Column:
        return F.when(of("h1") == 0, self.p_unigram(of)).otherwise((of("c2") + self.k) / (of("h1") + self.k * self.vocabulary))

    def p_trigram(self, of: Callable[[str], Column] = F.col) -> Column:
        return F.when(of("h2") == 0, self.p_bigram(of)).otherwise((of("c3") + self.k) / (of("h2") + self.k * self.vocabulary))

    def score(self, of: Callable[[str], Column] = F.col) -> Column:
        t, b, u = self.weights
        one = (b + t) * self.p_bigram(of) + u * self.p_unigram(of)
        two = t * self.p_trigram(of) + b * self.p_bigram(of) + u * self.p_unigram(of)
        return F.when(of("w1").isNull(), self.p_unigram(of)).when(of("w2").isNull(), one).otherwise(two)

    def score_of(self, c: dict[str, np.ndarray], no_w1: np.ndarray, no_w2: np.ndarray) -> np.ndarray:
        """score() of arrays."""
        (t, b, u), v = self.weights, self.k * self.vocabulary
        p1 = (c["c1"] + self.k) / (self.total + v)
        p2 = np.where(c["h1"] == 0, p1, (c["c2"] + self.k) / (c["h1"] + v))
        p3 = np.where(c["h2"] == 0, p2, (c["c3"] + self.k) / (c["h2"] + v))
        return np.where(no_w1, p1, np.where(no_w2, (b + t) * p2 + u * p1, t * p3 + b * p2 + u * p1))

    def scored(self, keys: DataFrame) -> DataFrame:
        return self.counted(keys).withColumns({"score": self.score(), "norm_score": normalized(self.score())})

    def scores(self, keys: DataFrame) -> DataFrame:
        return self.counted(keys).withColumn("score", self.score())

    def predict(self, contexts: DataFrame, k: int) -> DataFrame:
        """id, word, score, rank for contexts (id, w2, w1; null where missing): the best scored of what may follow, ties by word.

        After two words that is what follows both or the last one anywhere; after one word
        what follows it, and where that is less than 2k words the k most frequent others;
        without words the most frequent ones.
        """
        words = lambda rows: rows.where(F.col("word") != BOS)
        two = contexts.where("w1 is not null and w2 is not null")
        one = contexts.where("w1 is not null and w2 is null")
        after = contexts.where("w1 is not null").join(words(self.bi).withColumnRenamed("prev", "w1"), "w1").select("id", "w2", "w1", "word")
        both = two.join(words(self.tri).select(F.col("w1").alias("w2"), F.col("w2").alias("w1"), "word"), ["w2", "w1"]).select("id", "w2", "w1", "word")
        frequent = words(self.uni).orderBy(F.desc("count"), "word").limit(3 * k).withColumnRenamed("count", "n")  # 3k rows
        few = one.join(after.groupBy("id").agg(F.count("*").alias("have")), "id", "left").where(F.coalesce("have", F.lit(0)) < 2 * k)
        others = few.select("id", "w2", "w1").crossJoin(F.broadcast(frequent)).join(after.select("id", "word"), ["id", "word"], "left_anti")
        others = dictionary.top(others, ["id"], [F.desc("n"), F.col("word")], k, "place").select("id", "w2", "w1", "word")
        first = contexts.where("w1 is null").select("id", "w2", "w1").crossJoin(F.broadcast(frequent)).select("id", "w2", "w1", "word")
        found = after.unionByName(both).distinct().unionByName(others).unionByName(first)
        return dictionary.top(self.scores(found), ["id"], [F.desc("score"), F.col("word")], k).select("id", "word", "score", "rank")

    def predict_with_prefix(self, contexts: DataFrame, index: DataFrame, k: int) -> DataFrame:
        """id, surface, hangul, score, rank for contexts (id, w2, w1, prefix; one for each id): the best scored entries of the index (hangul, surface) that begin with the prefix.

        Among entries that never followed a context the more frequent one has the higher
        score, whatever the context is. So a context needs the k most frequent entries of its
        prefix, found once for each prefix, and those that did follow it, not all that begin so.
        """
        length = contexts.select(F.length("prefix").alias("n")).distinct()  # at most as many rows as the longest prefix has letters
        known = index.join(self.uni.select(F.col("word").alias("surface"), F.col("count").alias("c1")), "surface", "left").fillna(0, ["c1"])
        starts = known.join(F.broadcast(length), F.length("hangul") >= F.col("n")).withColumn("prefix", F.expr("substring(hangul, 1, n)"))
        first = dictionary.top(starts, ["prefix"], [F.desc("c1"), F.col("surface"), F.col("hangul")], k, "place")
        entry = lambda c2, c3: F.struct("surface", "hangul", "c1", c2.cast("long").alias("c2"), c3.cast("long").alias("c3"))
        most = written(first.groupBy("prefix").agg(F.collect_list(entry(F.lit(0), F.lit(0))).alias("most")))

        own = contexts.select("id", "w2", "w1", "prefix")
        after = own.join(self.bi.select(F.col("prev").alias("w1"), "word"), "w1").select("id", "w2", "w1", "prefix", "word")
        both = own.join(self.tri.select(F.col("w1").alias("w2"), F.col("w2").alias("w1"), "word"), ["w2", "w1"]).select("id", "w2", "w1", "prefix", "word")
        found = after.unionByName(both).where(F.col("prefix").isNotNull()).distinct()
        found = found.join(index.select("hangul", F.col("surface").alias("word")), "word").where(F.col("hangul").startswith(F.col("prefix")))
        each = self.counted(found).withColumnRenamed("word", "surface")
        seen = written(each.groupBy("id").agg(F.collect_list(entry(F.col("c2"), F.col("c3"))).alias("seen")))

        rows = own.join(self.uni.select(F.col("word").alias("w1"), F.col("count").alias("h1")), "w1", "left")
        rows = rows.join(self.bi.select(F.col("prev").alias("w2"), F.col("word").alias("w1"), F.col("count").alias("h2")), ["w2", "w1"], "left").fillna(0, ["h1", "h2"])
        rows = rows.join(most, "prefix").join(seen, "id", "left")
        others = F.filter("most", lambda x: ~F.coalesce(F.exists("seen", lambda y: y["surface"] == x["surface"]), F.lit(False)))
        every = F.concat(others, F.coalesce("seen", F.slice("most", 1, 0)))
        scored = F.transform(every, lambda x: F.struct((-self.score(lambda c: x[c] if c in ("c1", "c2", "c3") else F.col(c))).alias("less"), x["surface"].alias("surface"), x["hangul"].alias("hangul")))
        out = rows.select("id", F.posexplode(F.slice(F.array_sort(scored), 1, k)).alias("i", "e"))
        return out.select("id", "e.surface", "e.hangul", (-F.col("e.less")).alias("score"), (F.col("i") + 1).alias("rank"))


def normalized(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(p) + 15) / 15))
