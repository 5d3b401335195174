"""Kana and Hangul: transliteration, marks for long vowels and voicing, long-vowel patterns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jamo

# Kana and the syllables they are written with.
KANA = dict(
    zip(
        "あいうえお かきくけこ さしすせそ たちつてと なにぬねの はひふへほ まみむめも やゆよ らりるれろ わを がぎぐげご ざじずぜぞ だぢづでど ばびぶべぼ ぱぴぷぺぽ",
        "아이우에오 카키쿠케코 사시스세소 타치츠테토 나니누네노 하히후헤호 마미무메모 야유요 라리루레로 와오 가기구게고 자지즈제조 다지즈데도 바비부베보 파피푸페포",
        strict=True,
    )
)
del KANA[" "]
YOUON = dict(
    zip(
        "きゃ きゅ きょ しゃ しゅ しょ ちゃ ちゅ ちょ にゃ にゅ にょ ひゃ ひゅ ひょ みゃ みゅ みょ りゃ りゅ りょ ぎゃ ぎゅ ぎょ じゃ じゅ じょ びゃ びゅ びょ ぴゃ ぴゅ ぴょ".split(),
        "캬 큐 쿄 샤 슈 쇼 차 추 초 냐 뉴 뇨 햐 휴 효 먀 뮤 묘 랴 류 료 갸 규 교 자 주 조 뱌 뷰 뵤 퍄 퓨 표".split(),
        strict=True,
    )
)
LABIAL = "ばびぶべぼぱぴぷぺぽまみむめも"
# Fixed values of compatible output: the syllables that take a final as Unicode composes it, and those that take another.
REGULAR = {
    "ㄴ": "가게고구기나네니노누다데더도두마메머모무사세서소수시아에어오우이자제저조주타테터토투하헤허호후히카커코쿠키파페퍼포푸피바베버보부비냐샤슈쇼큐",
    "ㅁ": "가게고구기나네니노누다데더도두마메머모무사서소수시아에어오우이자제저조주타테터토투하헤허호후히카케커코쿠키파페퍼포푸피바버보부비",
    "ㅅ": "가게고구기나네노다마메머모무사서소수시아에어오우이자제주타테터토투헤허히카케커코쿠키페푸피바버보부",
}
OTHER = {
    "ㄴ": "케켠 냥냥 냉냉 냬냬 뉴눈 뉭뉭 뇨뇨 뇽뇽 샬샬 슬슬 쇄쇄 쇠쇠 캬캔 쿄쿤",
    "ㅁ": "세섬 베뱀",
    "ㅅ": "니닏 누뉻 데댓 더덛 도닷 두뒷 세섯 저젯 조좋 하핳 호홓 후훋 파팓 퍼펫 포팟 베벧 비빚",
}
_OTHER = {m: {pair[0]: pair[1] for pair in pairs.split()} for m, pairs in OTHER.items()}
VOICED = ("かきくけこさしすせそたちつてとはひふへほ", "がぎぐげござじずぜぞだぢづでどばびぶべぼ")
ROWS = {"あ": "あかがさざただなはばぱまやゃらわ", "い": "いきぎしじちぢにひびぴみり", "う": "うくぐすずつづぬふぶぷむゆゅる", "え": "えけげせぜてでねへべぺめれ", "お": "おこごそぞとどのほぼぽもよょろを"}
LENGTHENS = {"あ": "あ", "い": "い", "う": "う", "え": "い", "お": "う"}  # as spelled: せんせい, とうきょう
EXTENDS = {c: LENGTHENS[v] for v, row in ROWS.items() for c in row}

_UNIT = re.compile("|".join([*YOUON, "."]), re.DOTALL)


def close(text: str, mark: str, compat: bool = True) -> str:
    """The text with a final on its last syllable. Compatible output leaves syllables outside the fixed lists open and appends the letter."""
    if not text:
        return mark
    last = text[-1]
    if not compat:
        return text[:-1] + jamo.with_final(last, mark)
    if last in REGULAR[mark]:
        return text[:-1] + jamo.with_final(last, mark)
    return text[:-1] + _OTHER[mark].get(last, last + mark)


def to_hangul(text: str, compat: bool = True) -> str:
    """Hiragana in Hangul: small tsu closes with ㅅ, n with ㅁ before labials and else ㄴ, a long mark repeats the last bare vowel."""
    units, out = _UNIT.findall(text), ""
    for unit, after in zip(units, [*units[1:], ""], strict=False):
        if unit == "っ":
            out = close(out, "ㅅ", compat) if after else out
        elif unit == "ん":
            out = close(out, "ㅁ" if after[:1] and after[0] in LABIAL else "ㄴ", compat)
        elif unit == "ー":
            out += (out[-1] if out[-1] in "아이우에오유" else "우") if out else ""
        else:
            out += YOUON.get(unit) or KANA.get(unit, unit)
    return out


MARKS = str.maketrans("んっー", "ⓝⓧⓜ")


def to_marked(text: str) -> str:
    """Hiragana in Hangul, with n, small tsu and the long mark as signs of their own."""
    return "".join(YOUON.get(u) or KANA.get(u, u) for u in _UNIT.findall(text)).translate(MARKS)


def voice(text: Column) -> Column:
    """The text with its first kana voiced, where it has a voiced form."""
    return F.concat(F.translate(F.substring(text, 1, 1), *VOICED), F.substring(text, F.lit(2), F.length(text)))


def extension(text: Column) -> Column:
    """The kana that lengthens the last one; null where none does."""
    return F.create_map(*[F.lit(x) for pair in EXTENDS.items() for x in pair])[F.right(text, F.lit(1))]


def voice_text(text: str) -> str:
    return text[:1].translate(str.maketrans(*VOICED)) + text[1:]


# The long vowels that are looked for in readings.
LONG_PATTERNS = (
    "おう こう そう とう のう ほう もう よう ろう ごう ぞう どう ぼう ぽう "
    "きょう しょう ちょう にょう ひょう みょう りょう ぎょう じょう びょう "
    "えい けい せい てい ねい へい めい れい げい ぜい でい べい ぺい "
    "くう すう つう ふう ぐう ずう おお いい ああ ー"
).split()
# The long vowels whose last kana is written with a mark.
MARKED_PATTERNS = (
    "きょう しょう ちょう にょう ひょう みょう りょう ぎょう じょう びょう ぴょう "
    "きゅう しゅう ちゅう にゅう ひゅう みゅう りゅう ぎゅう じゅう びゅう ぴゅう "
    "おう こう そう とう のう ほう もう よう ろう ごう ぞう どう ぼう ぽう "
    "えい けい せい てい ねい へい めい れい げい ぜい でい べい ぺい "
    "くう すう つう ふう ぐう ずう ゆう おお いい ああ ええ うう"
).split()
_LONG = re.compile(f"(?=({'|'.join(LONG_PATTERNS)}))")
_MARKED = re.compile("|".join([*MARKED_PATTERNS, "."]), re.DOTALL)


def long_vowels(reading: str) -> list[tuple[int, str]]:
    """Places and patterns of the long vowels of a reading; no pattern begins another, so there is one at a place at most."""
    return [(m.start(), m[1]) for m in _LONG.finditer(reading)]


def with_marks(reading: str) -> str:
    """Hangul of a reading where the last kana of a long vowel is written ~; other kana are written one by one."""
    return "".join(to_hangul(u[:-1]) + "~" if len(u) > 1 else to_hangul(u) for u in _MARKED.findall(reading))


def _udf(f):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else f(x))

    return run


hangul = _udf(to_hangul)
hangul_exact = _udf(lambda x: to_hangul(x, compat=False))
marked = _udf(to_marked)
lengthened = _udf(with_marks)
