"""Hangul syllables as arithmetic on code points: column expressions, and keystroke composition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE, LAST, VOWELS, FINALS = 0xAC00, 0xD7A3, 21, 28

# Unicode's order of initial, medial and final letters, and the two-set keyboard.
INITIAL = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIAL = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINAL = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"  # from index 1; 0 is none
KEYS = "qwertyuiopasdfghjklzxcvbnm"
KEYED = "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡ"
SHIFT_KEYS, SHIFT_KEYED = "QWERTOP", "ㅃㅉㄸㄲㅆㅒㅖ"
VOWEL_PAIRS = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ"}
FINAL_PAIRS = {"ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ", "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ", "ㅂㅅ": "ㅄ"}


def is_syllable(ch: Column) -> Column:
    return F.ascii(ch).between(BASE, LAST)


def decompose(ch: Column) -> Column:
    """struct(cho, jung, jong) of a syllable; null for anything else."""
    n = F.ascii(ch) - BASE
    parts = F.struct(
        F.floor(n / (VOWELS * FINALS)).cast("int").alias("cho"), F.floor(n % (VOWELS * FINALS) / FINALS).cast("int").alias("jung"), (n % FINALS).cast("int").alias("jong")
    )
    return F.when(is_syllable(ch), parts)


def code_point(n: Column) -> Column:
    """The character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 4, "0")), "UTF-16BE")


def compose(cho: Column, jung: Column, jong: Column) -> Column:
    return code_point(F.lit(BASE) + (cho * VOWELS + jung) * FINALS + jong)


def letter(table: str, index: Column) -> Column:
    return F.substring(F.lit(table), index.cast("int") + 1, F.lit(1))


def initial(cho: Column) -> Column:
    return letter(INITIAL, cho)


def medial(jung: Column) -> Column:
    return letter(MEDIAL, jung)


def final(jong: Column) -> Column:
    """The final letter; empty for index 0."""
    return F.when(jong == 0, F.lit("")).otherwise(letter(FINAL, jong - 1))


def typed(keys: Column) -> Column:
    """The letters that keys of the two-set layout produce; other characters stay. Shift only matters for seven keys."""
    plain = "".join(k.upper() for k in KEYS if k.upper() not in SHIFT_KEYS)
    return F.translate(keys, KEYS + SHIFT_KEYS + plain, KEYED + SHIFT_KEYED + "".join(KEYED[KEYS.index(k.lower())] for k in plain))


def syllable(cho: int, jung: int, jong: int = 0) -> str:
    return chr(BASE + (cho * VOWELS + jung) * FINALS + jong)


def parts(ch: str) -> tuple[int, int, int] | None:
    n = ord(ch) - BASE
    return (n // (VOWELS * FINALS), n // FINALS % VOWELS, n % FINALS) if 0 <= n <= LAST - BASE else None


def with_final(ch: str, mark: str) -> str:
    """Arithmetic composition; a character that can't take the mark is followed by it."""
    p = parts(ch)
    return syllable(p[0], p[1], FINAL.index(mark) + 1) if p and p[2] == 0 else ch + mark


def compose_letters(letters: str, final_pairs: bool = True) -> str:
    """Letters as they are typed into syllables: each consonant that a vowel follows begins a syllable.

    A syllable is matched as initial, vowel (or pair of vowels), and finals, which are
    letters that no vowel follows; two of them only if they pair up and ``final_pairs``.
    """
    out, rest = [], letters
    while rest:
        if rest[0] in INITIAL and rest[1:2] and rest[1] in MEDIAL:
            cho, vowel, rest = rest[0], rest[1], rest[2:]
            if rest and vowel + rest[0] in VOWEL_PAIRS:
                vowel, rest = VOWEL_PAIRS[vowel + rest[0]], rest[1:]
            jong = 0
            closes = [i < len(rest) and rest[i] in FINAL and not (rest[i + 1 : i + 2] and rest[i + 1] in MEDIAL) for i in (0, 1)]
            if final_pairs and all(closes) and rest[:2] in FINAL_PAIRS:
                jong, rest = FINAL.index(FINAL_PAIRS[rest[:2]]) + 1, rest[2:]
            elif closes[0]:
                jong, rest = FINAL.index(rest[0]) + 1, rest[1:]
            out.append(syllable(INITIAL.index(cho), MEDIAL.index(vowel), jong))
        elif rest[:2] in VOWEL_PAIRS:
            out.append(VOWEL_PAIRS[rest[:2]])
            rest = rest[2:]
        else:
            out.append(rest[0])
            rest = rest[1:]
    return "".join(out)


@F.pandas_udf(T.StringType())
def composed(letters: pd.Series) -> pd.Series:
    return letters.map(lambda x: None if x is None else compose_letters(x))


@F.pandas_udf(T.StringType())
def composed_single_finals(letters: pd.Series) -> pd.Series:
    return letters.map(lambda x: None if x is None else compose_letters(x, final_pairs=False))
