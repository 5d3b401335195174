"""Decoding Hangul with a learned map: beam search, rules for known words and endings, marks.

The map of syllable tokens has a bounded size (LIMIT rows are checked before it is sent to
executors); beyond it decode_by_join() finds the tokens of each word by a join first.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jamo, kana, romaji

FLOOR, FALLBACK, UNKNOWN, LIMIT, LONGEST = 0.01, 0.3, -20.0, 2_000_000, 3
CANDIDATES = T.ArrayType(T.StructType([T.StructField("hira", T.StringType()), T.StructField("conf", T.DoubleType())]))

# Words and endings with readings of their own; endings are tried in this order.
KNOWN_WORDS = {
    "사쿠라": "さくら",
    "아리가토": "ありがとう",
    "아리가토고자이마스": "ありがとうございます",
    "스미마셍": "すみません",
    "곤니찌와": "こんにちわ",
    "오하요": "おはよう",
    "오하요고자이마스": "おはようございます",
    "하지메마시테": "はじめまして",
    "사요나라": "さようなら",
    "이타다키마스": "いただきます",
}
ENDINGS = {"데스카": "ですか", "데스요": "ですよ", "데스네": "ですね", "데스": "です", "마스카": "ますか", "마시타": "ました", "마스": "ます", "와": "は", "가": "が"}
# What finals (indices as compatible output has them) may stand for, and weights of variants.
FINAL_SIGNS = {2: "ん", 6: "ん", 21: "ん", 1: "っ", 7: "っ", 17: "っ", 9: "っ", 10: "っ"}
VARIANTS = {"ん": 0.7, "っ": 0.6, "ー": 0.5}
_LONG_U = re.compile("(?<=[%s])う" % "".join(c + chr(ord(c) + 96) for row in kana.ROWS.values() for c in row if c not in "ゃゅょ"))  # after kana of either script

Map = dict[str, list[tuple[str, float]]]


def collected(table: DataFrame) -> Map:
    """The map as a dict, after a check of its size."""
    rows = table.select("token", "hira", "prob", "rnk").limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"a map of more than {LIMIT} rows is not sent to executors; use decode_by_join")
    out: Map = {}
    for r in sorted(rows, key=lambda r: (r.token, r.rnk)):
        out.setdefault(r.token, []).append((r.hira, r.prob))
    return out


def beam(word: str, table: Map, width: int = 6, most: int = 10) -> list[tuple[str, float]]:
    """Readings with confidences, likeliest first; ties by reading.

    Hypotheses are kept by place in one pruned pool, as tokens of one to three syllables
    reach different places in the same round.
    """
    pool: list[tuple[float, str, int]] = [(0.0, "", 0)]
    if not word:
        return []
    while any(at < len(word) for _, _, at in pool):
        after = [s for s in pool if s[2] >= len(word)]
        for lp, hira, at in (s for s in pool if s[2] < len(word)):
            for n in range(min(LONGEST, len(word) - at), 1, -1):
                after += [(lp + math.log(p), hira + h, at + n) for h, p in table.get(word[at : at + n], [])[:width] if p >= FLOOR]
            one = table.get(word[at])
            if one is not None:
                after += [(lp + math.log(p), hira + h, at + 1) for h, p in one[:width] if p >= FLOOR]
            elif spare := romaji.fallback(word[at]):
                after += [(lp + math.log(w * FALLBACK), hira + h, at + 1) for h, w in spare if w > 0]
            else:
                after.append((lp + UNKNOWN, hira + word[at], at + 1))
        pool = sorted((s for s in after if math.isfinite(s[0])), key=lambda s: (-s[0], s[1], s[2]))[: 3 * width]
    pool = [s for i, s in enumerate(pool) if i == 0 or pool[i - 1][1] != s[1]]
    return [(hira, math.exp(lp)) for lp, hira, _ in pool[:most]]


def marked_word(word: str, table: Map) -> str:
    """Each syllable's best reading, voiced by ^ and lengthened by ~; marks without a syllable go."""
    out, i = "", 0
    while i < len(word):
        ch, i = word[i], i + 1
        if ch in "~^":
            continue
        marks = ""
        while i < len(word) and word[i] in "~^":
            marks, i = marks + word[i], i + 1
        hira = table[ch][0][0] if table.get(ch) else next((h for h, _ in romaji.fallback(ch)), ch)
        hira = kana.voice_text(hira) if "^" in marks else hira
        out += hira + (kana.EXTENDS.get(hira[-1:], "") if "~" in marks else "")
    return out


def word(text: str, table: Map, width: int = 6, most: int = 5, surfaces: dict[str, str] | None = None) -> str:
    """Marks first, then known words, then known endings peeled off from behind, then the beam's best."""
    tail = ""
    while text:
        if "~" in text or "^" in text:
            return marked_word(text, table) + tail
        if text in KNOWN_WORDS:
            return KNOWN_WORDS[text] + tail
        ending = next((e for e in ENDINGS if text.endswith(e)), None)
        if ending is None:
            best = next(iter(beam(text, table, width, most)), ("", 0.0))[0]
            return (surfaces or {}).get(best, best) + tail
        text, tail = text[: -len(ending)], ENDINGS[ending] + tail
    return tail


def sentence(text: str, table: Map, **options) -> str:
    out, run = [], ""
    for ch in text:
        if ch.isspace():
            out += [word(run, table, **options), ch]
            run = ""
        else:
            run += ch
    return "".join([*out, word(run, table, **options)])


def variants(hira: str, original: str) -> list[tuple[str, float]]:
    """Readings with one n or small tsu put in after the place of a syllable with such a final, or one u as a long mark; and their weights."""
    signs = [(i, FINAL_SIGNS[p[2]]) for i, ch in enumerate(original) if (p := jamo.parts(ch)) and p[2] in FINAL_SIGNS]
    out = [(hira[: i + 1] + sign + hira[i + 1 :], VARIANTS[sign]) for i, sign in signs]
    return out + [(hira[: m.start()] + "ー" + hira[m.end() :], VARIANTS["ー"]) for m in _LONG_U.finditer(hira)]


def hybrid(text: str, table: Map, width: int = 6, most: int = 10, original: str | None = None) -> list[tuple[str, float]]:
    """The beam's readings and the variants of each by the finals of what was typed, likeliest first; of equal neighbours the first stays."""
    rows = [r for hira, conf in beam(text, table, width, most) for r in [(hira, conf), *((v, conf * w) for v, w in variants(hira, text if original is None else original))]]
    rows.sort(key=lambda r: -r[1])
    return [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][0] != r[0]][:most]


def rule_based(text: str, most: int = 10) -> list[tuple[str, str, float]]:
    """hira, romaji, conf by letters alone: romaji readings in kana, equal neighbours merged."""
    rows = sorted(((romaji.to_hiragana(r), r, w) for r, w in romaji.readings(text, most)), key=lambda r: -r[2])
    return [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][0] != r[0]]


def _sent(table: DataFrame):
    return table.sparkSession.sparkContext.broadcast(collected(table))


def candidates(words: DataFrame, table: DataFrame, column: str = "hangul", width: int = 6, most: int = 10) -> DataFrame:
    """All columns of ``words`` and candidates array<struct<hira, conf>>."""
    sent = _sent(table)

    @F.pandas_udf(CANDIDATES)
    def run(text: pd.Series) -> pd.Series:
        cache: dict[str, list] = {}
        out = []
        for t in text:
            if t is not None and t not in cache:
                cache[t] = [{"hira": h, "conf": c} for h, c in beam(t, sent.value, width, most)]
            out.append(None if t is None else cache[t])
        return pd.Series(out)

    return words.withColumn("candidates", run(column))


def sentences(rows: DataFrame, table: DataFrame, column: str = "hangul", width: int = 4, most: int = 1, surfaces: DataFrame | None = None) -> DataFrame:
    """All columns and decoded; ``surfaces`` (reading, surface, load_seq) writes words in the first surface of their reading."""
    sent = _sent(table)
    written = None
    if surfaces is not None:
        from .dictionary import first_wins

        first = first_wins(surfaces.select("reading", "surface", "load_seq"), ["reading"], "load_seq").limit(LIMIT + 1).collect()
        if len(first) > LIMIT:
            raise ValueError(f"surfaces of more than {LIMIT} readings are not sent to executors")
        written = rows.sparkSession.sparkContext.broadcast({r.reading: r.surface for r in first})

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        more = written.value if written is not None else None
        return text.map(lambda t: None if t is None else sentence(t, sent.value, width=width, most=most, surfaces=more))

    return rows.withColumn("decoded", run(column))


def fold(word_: Column, lookup: Column, width: int = 6, most: int = 10) -> Column:
    """The beam as a native fold for maps of single characters: ``lookup`` is map<token, array<struct<h, p>>>, likeliest first.

    Characters without an entry pass at a fixed cost. array<struct<lp, h>>, likeliest first, ties by reading.
    """
    order = lambda s: F.sort_array(F.transform(s, lambda x: F.struct((-x["lp"]).alias("k"), x["h"].alias("h"))))
    pruned = lambda s: F.transform(F.slice(order(s), 1, 3 * width), lambda x: F.struct((-x["k"]).alias("lp"), x["h"].alias("h")))
    none = F.array(F.struct(F.lit(math.exp(UNKNOWN)).alias("p")))

    def step(state: Column, ch: Column) -> Column:
        options = F.filter(F.slice(lookup[ch], 1, width), lambda m: m["p"] >= FLOOR)
        known = F.flatten(F.transform(state, lambda s: F.transform(options, lambda m: F.struct((s["lp"] + F.log(m["p"])).alias("lp"), F.concat(s["h"], m["h"]).alias("h")))))
        other = F.flatten(F.transform(state, lambda s: F.transform(none, lambda m: F.struct((s["lp"] + F.log(m["p"])).alias("lp"), F.concat(s["h"], ch).alias("h")))))
        return pruned(F.when(lookup[ch].isNotNull(), known).otherwise(other))

    start = F.array(F.struct(F.lit(0.0).alias("lp"), F.lit("").alias("h")))
    return F.slice(F.aggregate(F.filter(F.split(word_, ""), lambda c: c != ""), start, step), 1, most)


def decode_by_join(words: DataFrame, table: DataFrame, column: str = "hangul", width: int = 6, most: int = 10) -> DataFrame:
    """candidates() for maps of any size: each distinct word meets its tokens in a join, then carries its own small map."""
    w = words.select(F.col(column).alias("__w")).distinct()
    n = F.length("__w")

    def of_length(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("__w"), i, F.lit(k)))

    spans = [of_length(k) for k in range(1, LONGEST + 1)]
    tokens = w.select("__w", F.explode(F.array_distinct(F.flatten(F.array(*[F.when(n >= k, s).otherwise(F.array().cast("array<string>")) for k, s in enumerate(spans, 1)])))).alias("token"))
    own = tokens.join(table, "token").groupBy("__w").agg(F.sort_array(F.collect_list(F.struct("token", "rnk", "hira", "prob"))).alias("own"))

    @F.pandas_udf(CANDIDATES)
    def run(text: pd.Series, own_: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(text, own_, strict=True):
            m: Map = {}
            for r in rows if rows is not None else []:
                m.setdefault(r["token"], []).append((r["hira"], r["prob"]))
            out.append([{"hira": h, "conf": c} for h, c in beam(t, m, width, most)])
        return pd.Series(out)

    found = w.join(own, "__w", "left").select("__w", run("__w", "own").alias("candidates"))
    return words.join(found, words[column] == found["__w"], "left").drop("__w")
