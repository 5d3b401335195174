"""Autocomplete: strict prefixes, exact readings, next words; and simulated typing.

A batch of queries is answered by joins: the index is exploded by its prefixes once, so a
query meets its completions by equality. Contexts are what was committed before, which
a simulation knows in advance, so all keystrokes of all sentences are one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import decode, dictionary, ngram, ranking

WEIGHTS, COMPLETIONS, MOST, CONTEXT = (0.1, 0.35, 0.25, 0.3), 30, 10, 20


def surface_index(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """hangul, surface, frequency: entries of each reading and the reading itself at 0; of equal neighbours by frequency the first stays."""
    base = pairs.select("hangul", "reading").distinct()
    found = base.join(entries.select("reading", "surface", "frequency"), "reading").select("hangul", "surface", "frequency")
    both = found.unionByName(base.select("hangul", F.col("reading").alias("surface"), F.lit(0).cast("long").alias("frequency")))
    return dictionary.consecutive_distinct(both, ["hangul"], [F.desc("frequency"), F.col("surface")], "surface")


def completions(index: DataFrame, queries: DataFrame, most: int = COMPLETIONS) -> DataFrame:
    """id, surface, hangul, frequency, saving for queries (id, partial): entries whose Hangul goes on after it."""
    n = F.length("hangul")
    prefixes = index.where(n > 1).select("hangul", "surface", "frequency", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("hangul", F.lit(1), i))).alias("partial"))
    # the order of completions does not depend on the query: each prefix keeps its first ones before any meets it
    best = dictionary.top(prefixes, ["partial"], [F.desc("frequency"), F.col("hangul"), F.col("surface")], most, "place").drop("place")
    found = queries.where(F.length("partial") > 0).join(best, "partial")
    return found.select("id", "surface", "hangul", "frequency", (F.length("hangul") - F.length("partial")).alias("saving"))


def next_words(model: ngram.NgramModel, queries: DataFrame, index: DataFrame, most: int = MOST) -> DataFrame:
    """id, surface, hangul, saving, rank for queries (id, words) with an empty partial."""
    size = F.size("words")
    ctx = queries.select("id", F.when(size > 1, F.get("words", size - 2)).alias("w2"), F.when(size > 0, F.get("words", size - 1)).alias("w1"))
    found = model.predict(ctx, most).withColumnRenamed("word", "surface")
    reverse = index.groupBy("surface").agg(F.min("hangul").alias("hangul"))
    out = found.join(reverse, "surface", "left").withColumn("hangul", F.coalesce("hangul", "surface"))
    return out.select("id", "surface", "hangul", F.length("hangul").alias("saving"), "rank")


def suggestions(queries: DataFrame, index: DataFrame, entries: DataFrame, model: ngram.NgramModel, vectors: DataFrame, phonetic: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """id, surface, hangul, score, saving, tier, rank for queries (id, partial, words).

    The first of each surface stays, completions before exact readings, whatever its score.
    """
    typed = queries.where(F.length("partial") > 0)
    prefix = completions(index, typed).select("id", "surface", "hangul", "frequency", "saving", F.lit(0.5).alias("conf"), F.lit(0).alias("order"))
    rows = prefix
    if phonetic is not None:
        cands = decode.candidates(typed.select("id", "partial"), phonetic, "partial", 8, 20).select("id", F.col("partial").alias("hangul"), F.explode("candidates").alias("c"))
        exact = dictionary.with_self(cands.select("id", "hangul", "c.hira", "c.conf"), entries)
        rows = rows.unionByName(exact.select("id", "surface", "hangul", "frequency", F.lit(0).alias("saving"), "conf", F.lit(1).alias("order")))
    first = dictionary.first_wins(rows.withColumn("less", -F.col("frequency")), ["id", "surface"], "order", "less", "hangul").drop("less")
    scored = ranking.context_score(first, typed.select("id", "words"), vectors)
    size = F.size("words")
    last = typed.select("id", F.get("words", size - 2).alias("w2"), F.get("words", size - 1).alias("w1"))
    keys = scored.select("id", "surface", F.col("surface").alias("word")).join(last, "id")
    scored = scored.join(model.scored(keys).select("id", "surface", "norm_score"), ["id", "surface"])
    a, b, c, d = WEIGHTS
    score: Column = a * F.col("conf") + b * F.col("context_score") + c * F.col("frequency") / 10_000 + d * F.col("norm_score")
    ranked = scored.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "surface")))
    out = ranked.select("id", "surface", "hangul", "score", "saving", F.lit("PrefixCompletion").alias("tier"), "rank")  # exact readings too
    after = next_words(model, queries.where(F.length("partial") == 0), index, most)
    out = out.unionByName(after.select("id", "surface", "hangul", (1.0 / F.col("rank")).alias("score"), "saving", F.lit("NextWord").alias("tier"), "rank"))
    return out.where(F.col("rank") <= most)


def typed_words(sentences: DataFrame) -> DataFrame:
    """wid, sid, at, surface, hangul, words (what was committed before, the last 20) of sentences (sid, words array<struct<surface, hangul, ...>>)."""
    w = F.col("words")
    before = lambda i: F.transform(F.slice(w, F.greatest(i - CONTEXT + 1, F.lit(1)), F.least(i, F.lit(CONTEXT))), lambda x: x["surface"])
    each = F.transform(w, lambda x, i: F.struct(i.alias("at"), x["surface"].alias("surface"), x["hangul"].alias("hangul"), before(i).alias("words")))
    return sentences.select("sid", F.explode(each).alias("e")).select(F.concat_ws("/", F.col("sid").cast("string"), F.col("e.at").cast("string")).alias("wid"), "sid", "e.*")


def seen_parts(contexts: DataFrame, vectors: DataFrame) -> DataFrame:
    """words, context of distinct contexts (words): what suggestions see of them, the last two words and those with a vector.

    Others become null where they stand between, as vectors weigh by the distance from the
    end, and go at the start. So contexts that get the same suggestions are one context.
    """
    each = contexts.select("words", F.posexplode("words").alias("i", "word")).join(vectors.select("word", F.lit(True).alias("has")).distinct(), "word", "left")
    keep = F.coalesce("has", F.lit(False)) | (F.col("i") >= F.size("words") - 2)
    rows = each.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("i", keep.alias("keep"), "word"))).alias("a"))
    first = F.array_position(F.transform("a", lambda e: e["keep"]), F.lit(True)).cast("int")
    return rows.select("words", F.transform(F.slice("a", first, F.size("a")), lambda e: F.when(e["keep"], e["word"])).alias("context"))


def keystrokes(typed: DataFrame, threshold: int, index: DataFrame, entries: DataFrame, model: ngram.NgramModel, vectors: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """cid, plain, used, next_hit, prefix_hits of a table that is written, with typed words (cid, surface, hangul, words).

    A next word costs one key. Else the first prefix whose top suggestion is the word and
    saves enough is accepted with one more key; one at full length counts as a hit but not as saving.
    """
    seen = seen_parts(typed.select("words").distinct(), vectors)
    each = typed.join(seen, "words", "left").withColumn("context", F.coalesce("context", "words"))
    each = each.select("cid", "surface", "hangul", "context", F.explode(F.sequence(F.lit(0), F.length("hangul"))).alias("i"))
    each = each.where((F.col("i") > 0) | (F.size("context") > 0)).withColumn("partial", F.substring("hangul", F.lit(1), F.col("i")))
    each = each.withColumn("id", F.concat_ws("\x1f", "partial", F.array_join("context", "\x1e", "\x1d")))
    asked = written(each.select("id", "partial", F.col("context").alias("words")).dropDuplicates(["id"]))  # the same keys after the same words are answered once
    top = written(suggestions(asked, index, entries, model, vectors, phonetic).where("rank = 1").select("id", F.col("surface").alias("top"), "saving", "tier"))
    hit = each.select("cid", "surface", F.length("hangul").alias("n"), "i", "id").join(top, "id", "left").withColumn("hit", F.coalesce(F.col("top") == F.col("surface"), F.lit(False)))
    i, full = F.col("i"), F.col("n")
    good = F.col("hit") & (i > 0) & (F.col("saving") >= threshold)
    out = hit.groupBy("cid").agg(
        F.max(full).alias("n"), F.max(F.when(F.col("hit") & (i == 0), 1).otherwise(0)).alias("next_hit"), F.min(F.when(good & (i < full), i)).alias("accepted"), F.max(F.when(good & (i == full), 1).otherwise(0)).alias("late")
    )
    used = F.when(F.col("next_hit") == 1, 1).when(F.col("accepted").isNotNull(), F.col("accepted") + 1).otherwise(F.col("n") + 1)
    hits = F.when(F.col("next_hit") == 1, 0).when(F.col("accepted").isNotNull(), 1).otherwise(F.col("late"))
    return out.select("cid", (F.col("n") + 1).alias("plain"), used.alias("used"), "next_hit", hits.alias("prefix_hits"))


def distinct_typed(words: DataFrame) -> DataFrame:
    """cid, surface, hangul, words, times: each word after each context once, as a table that is written."""
    return written(words.groupBy("surface", "hangul", "words").agg(F.count("*").alias("times")).withColumn("cid", F.monotonically_increasing_id()))


def simulated(sentences: DataFrame, threshold: int, index: DataFrame, entries: DataFrame, model: ngram.NgramModel, vectors: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """wid, sid, plain, used, next_hit, prefix_hits: keystrokes of every word, see keystrokes()."""
    words = typed_words(sentences)
    typed = distinct_typed(words)
    keys = [typed[c].eqNullSafe(words[c]) for c in ("surface", "hangul", "words")]
    each = words.join(typed, keys).select("wid", "sid", "cid")
    return each.join(keystrokes(typed, threshold, index, entries, model, vectors, phonetic), "cid").drop("cid")


def totals(sentences: DataFrame, threshold: int, index: DataFrame, entries: DataFrame, model: ngram.NgramModel, vectors: DataFrame, phonetic: DataFrame | None = None) -> DataFrame:
    """words, plain, used, next_hits, prefix_hits: sums over all words of simulated(), without a row for each."""
    typed = distinct_typed(typed_words(sentences))
    each = keystrokes(typed, threshold, index, entries, model, vectors, phonetic).join(typed.select("cid", "times"), "cid")
    sums = {"words": F.lit(1), "plain": F.col("plain"), "used": F.col("used"), "next_hits": F.col("next_hit"), "prefix_hits": F.col("prefix_hits")}
    return each.agg(*[F.sum(x * F.col("times")).alias(c) for c, x in sums.items()]).withColumn("words", F.coalesce("words", F.lit(0).cast("long")))
