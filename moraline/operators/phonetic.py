"""Learning token maps: aligned pairs become conditional probabilities of kana given Hangul.

A map is a table (token, hira, freq, prob, rnk). Alignment walks both strings once and is
the only part in Python; counting and normalising are aggregations by token.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kana

PAIRS = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("hira", T.StringType())]))
KEEP = 0.005
# Two-sign tokens that lengthen a syllable, for augmented maps.
LONG_MARKS = dict(
    pair.split(":")
    for pair in (
        "오~:おう 코~:こう 소~:そう 토~:とう 노~:のう 호~:ほう 모~:もう 요~:よう 로~:ろう 고~:ごう 조~:ぞう 도~:どう 보~:ぼう 포~:ぽう "
        "에~:えい 케~:けい 세~:せい 테~:てい 네~:ねい 헤~:へい 메~:めい 레~:れい 게~:げい 제~:ぜい 데~:でい 베~:べい 페~:ぺい "
        "쿠~:くう 스~:すう 츠~:つう 후~:ふう 구~:ぐう 즈~:ずう 유~:ゆう "
        "쿄~:きょう 쇼~:しょう 쵸~:ちょう 뇨~:にょう 효~:ひょう 묘~:みょう 료~:りょう 교~:ぎょう 죠~:じょう 뵤~:びょう "
        "큐~:きゅう 슈~:しゅう 츄~:ちゅう 뉴~:にゅう 휴~:ひゅう 뮤~:みゅう 류~:りゅう 규~:ぎゅう 쥬~:じゅう 뷰~:びゅう "
        "아~:ああ 이~:いい"
    ).split()
)
SIGNS = {"ⓝ": "ん", "ⓧ": "っ", "ⓜ": "ー"}


def units(reading: str, hangul: str, silent: str) -> list[tuple[int, int, int]]:
    """(kana from, kana to, syllable number) of an alignment; kana of ``silent`` have no syllable of their own.

    Two kana stand for one syllable if they are written as exactly that syllable; otherwise
    kana and syllables pair up one by one, even where they don't match.
    """
    out, h, s = [], 0, 0
    while h < len(reading) and s < len(hangul):
        if reading[h] in silent:
            h += 1
            continue
        wide = 2 if len(reading) > h + 1 and kana.to_hangul(reading[h : h + 2]) == hangul[s] else 1
        out.append((h, h + wide, s))
        h, s = h + wide, s + 1
    return out


def marked_units(reading: str, hangul: str) -> list[tuple[int, int, int]]:
    """The alignment with signs: a sign stands for its own kana, and without it for nothing; that kana without a sign is left out.

    Small ya, yu and yo belong to the kana before if both are written as one syllable; all else pairs one by one.
    """
    out, h = [], 0
    for s, sign in enumerate(hangul):
        own = SIGNS.get(sign)
        while own is None and reading[h : h + 1] in SIGNS.values():
            h += 1
        if h == len(reading):
            break
        if own is None or own == reading[h]:
            wide = 2 if own is None and reading[h + 1 : h + 2] in ("ゃ", "ゅ", "ょ") and kana.to_hangul(reading[h : h + 2]) == sign else 1
            out.append((h, h + wide, s))
            h += wide
    return out


def aligned_pairs(reading: str, hangul: str, longest: int = 1, signs: bool = False) -> list[tuple[str, str]]:
    """(token, kana) of single syllables and of runs up to ``longest`` of them.

    Without signs a run ends one kana after the start of its last syllable's, so it may
    cut a pair of kana; with signs it ends where that does.
    """
    found = marked_units(reading, hangul) if signs else units(reading, hangul, "んっ")
    out = [(hangul[s], reading[a:b]) for a, b, s in found]
    if longest > 1:
        spans = found if signs else units(reading, hangul, "んっー")
        begin = {s: a for a, _, s in spans}
        end = {s: b if signs else min(a + 1, len(reading)) for a, b, s in spans}
        last = max((b for _, b, _ in spans), default=0)
        for s in range(len(hangul)):  # syllables beyond the kana stand at the last one
            begin.setdefault(s, max(last - 1, 0))
            end.setdefault(s, min(max(last - 1, 0) + 1, len(reading)))
        for n in range(2, longest + 1):
            for s in range(len(hangul) - n + 1):
                a, b = begin[s], end[s + n - 1]
                if a < b:
                    out.append((hangul[s : s + n], reading[a:b]))
    return out


def _pairs_udf(longest: int, signs: bool):
    @F.pandas_udf(PAIRS)
    def run(reading: pd.Series, hangul: pd.Series) -> pd.Series:
        return pd.Series([[{"token": t, "hira": k} for t, k in aligned_pairs(r or "", h or "", longest, signs)] for r, h in zip(reading, hangul, strict=True)])

    return run


def word_counts(words: DataFrame, reading: str = "reading", hangul: str = "hangul") -> DataFrame:
    return words.groupBy(F.col(reading).alias("reading"), F.col(hangul).alias("hangul")).agg(F.count("*").alias("freq"))


def pair_counts(pairs: DataFrame, longest: int = 1, signs: bool = False) -> DataFrame:
    """token, hira, freq of pairs (reading, hangul, freq), aligned once for each distinct pair."""
    hangul = kana.marked("reading") if signs else F.col("hangul")
    each = pairs.select("freq", F.explode(_pairs_udf(longest, signs)("reading", hangul)).alias("p"))
    return each.groupBy("p.token", "p.hira").agg(F.sum("freq").alias("freq"))


def probabilities(counts: DataFrame, keep: float | None = None) -> DataFrame:
    """token, hira, freq, prob, rnk: shares of each token's total, likeliest first, ties by kana; shares up to ``keep`` go, without renormalising."""
    total = counts.groupBy("token").agg(F.sum("freq").alias("total"))
    out = counts.join(total, "token").select("token", "hira", "freq", (F.col("freq") / F.col("total")).alias("prob"))
    out = out if keep is None else out.where(F.col("prob") > keep)
    return out.withColumn("rnk", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("prob"), "hira")))


def learned(pairs: DataFrame, longest: int = 1, signs: bool = False) -> DataFrame:
    return probabilities(pair_counts(pairs, longest, signs), KEEP if longest > 1 else None)


def map_stats(table: DataFrame) -> DataFrame:
    """tokens, mappings, avg_ambiguity, max_ambiguity: one row."""
    n = table.groupBy("token").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("mappings"), F.avg("n").alias("avg_ambiguity"), F.max("n").alias("max_ambiguity"))


def augmented(table: DataFrame, total: int, prob: float = 0.95) -> DataFrame:
    """A map with the fixed lengthened tokens added at a fixed probability, ranked anew but not renormalised."""
    rows = [(t, h, max(total, 1) // 100, prob) for t, h in LONG_MARKS.items()]
    more = table.sparkSession.createDataFrame(rows, "token string, hira string, freq long, prob double")
    out = table.select("token", "hira", "freq", "prob").unionByName(more)
    return out.withColumn("rnk", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("prob"), "hira")))
