"""Words: conjugation, classes, and whitespace-preserving splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For the last kana of a dictionary form, its stems before masu, te, ta and nai.
GODAN = {
    "う": ("い", "って", "った", "わ"),
    "く": ("き", "いて", "いた", "か"),
    "ぐ": ("ぎ", "いで", "いだ", "が"),
    "す": ("し", "して", "した", "さ"),
    "つ": ("ち", "って", "った", "た"),
    "ぬ": ("に", "んで", "んだ", "な"),
    "ぶ": ("び", "んで", "んだ", "ば"),
    "む": ("み", "んで", "んだ", "ま"),
    "る": ("", "て", "た", ""),
}
IRREGULAR = {"する": ("し", "して", "した", "し"), "くる": ("き", "きて", "きた", "こ"), "いく": ("いき", "いって", "いった", "いか")}
FORMS = {"masu": (0, "ます"), "te": (1, ""), "ta": (2, ""), "nai": (3, "ない")}


def conjugated(reading: Column, form: str) -> Column:
    """A verb's reading in one of FORMS; words that don't end like a verb stay as they are."""
    i, tail = FORMS[form]
    stem = F.substring(reading, F.lit(1), F.length(reading) - 1)
    out = F.when(reading == "する", IRREGULAR["する"][i] + tail)
    for word, forms in list(IRREGULAR.items())[1:]:
        out = out.when(reading == word, forms[i] + tail)
    for kana, forms in GODAN.items():
        out = out.when(reading.endswith(kana), F.concat(stem, F.lit(forms[i] + tail)))
    return out.otherwise(reading)


def conjugate(reading: str, form: str) -> str:
    i, tail = FORMS[form]
    if reading in IRREGULAR:
        return IRREGULAR[reading][i] + tail
    forms = GODAN.get(reading[-1:])
    return reading[:-1] + forms[i] + tail if forms else reading


# Particles, and the ends of verbs.
PARTICLES = ("は", "が", "を", "に", "で", "と", "の", "も", "から", "まで", "より", "へ")
VERB_ENDS = ("ます", "した", "して", "ない", "った", "いた", "んだ", "いで")


def word_class(surface: Column, reading: Column) -> Column:
    """particle, verb, adjective, auxiliary (other words with です) or noun, by the ends of a word as written and as read."""
    ends = [surface.endswith(e) for e in VERB_ENDS]
    polite, plain = surface.endswith("です"), surface.endswith("い") & reading.endswith("い") & (F.length(surface) > 1)
    adjective = (polite & reading.endswith("いです")) | (~polite & plain)
    return F.when(surface.isin(*PARTICLES), "particle").when(F.greatest(*ends), "verb").when(adjective, "adjective").when(polite, "auxiliary").otherwise("noun")


def pieces(text: Column) -> Column:
    """Runs without white space, and white space one character each; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit(r"\s|\S+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks, tabs and line breaks."""
    return F.filter(F.split(F.lower(text), "[ \t\n\r]+"), lambda w: w != "")


def bound(x: Column, f) -> Column:
    """f(x) with x computed once for each row: inside lambdas a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
