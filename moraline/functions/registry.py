"""The functions by name, for SQL: register(spark) adds them to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import jamo, kana, romaji


@udtf(returnType="hira string, romaji string, conf double, rnk int")
class RuleReadings:
    """Readings of a Hangul word by its letters alone: SELECT * FROM rule_readings('사쿠라', 10)."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        from ..operators.decode import rule_based

        for i, (hira, latin, conf) in enumerate(rule_based(text or "", int(most)), 1):
            yield hira, latin, conf, i


@udtf(returnType="hira string, weight double, rnk int")
class FallbackReadings:
    """Hiragana of one syllable that no learned map has."""

    def eval(self, syllable: str) -> Iterator[tuple]:
        for i, (hira, weight) in enumerate(romaji.fallback(syllable or ""), 1):
            yield hira, weight, i


@udtf(returnType="at int, pattern string")
class LongVowels:
    def eval(self, reading: str) -> Iterator[tuple]:
        yield from kana.long_vowels(reading or "")


FUNCTIONS = {
    "kana_to_hangul": kana.hangul,
    "kana_to_hangul_exact": kana.hangul_exact,
    "kana_to_marked": kana.marked,
    "kana_with_marks": kana.lengthened,
    "romaji_to_hiragana": romaji.hiragana,
    "romaji_readings": romaji.romaji_readings,
    "compose_letters": jamo.composed,
    "compose_letters_single": jamo.composed_single_finals,
}
TABLE_FUNCTIONS = {"rule_readings": RuleReadings, "fallback_readings": FallbackReadings, "long_vowels": LongVowels}


def register(spark: SparkSession) -> list[str]:
    """Adds all functions and table functions to the session; their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
