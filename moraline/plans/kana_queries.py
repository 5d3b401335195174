"""Queries over kana and Hangul that are made from the keys of lineitem, with the SQL they must agree with.

The SQL reads the same fixed tables of kana and syllables, as text; its logic is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jamo, kana, romaji, words
from ..operators import decode, evaluation, phonetic
from .catalogue import query, table

_KANA, _HANGUL = "".join(kana.KANA), "".join(kana.KANA.values())
_YOUON, _YOUON_HANGUL = list(kana.YOUON), list(kana.YOUON.values())


def listed(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def picked(items, key: Column) -> Column:
    """The item at the place of a key modulo their number."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (key % len(items) + 1).cast("int"))


def parts(spark, sf_dir) -> DataFrame:
    """k1, mid, k2, k3, tail: what readings are put together from, a row for each line; k3 is a pair of kana in every third."""
    a, b, c = (F.col(x) for x in ("l_orderkey", "l_partkey", "l_suppkey"))
    last = F.when(F.col("l_linenumber") % 3 == 0, picked(_YOUON, c)).otherwise(picked(_KANA, c))
    tail = F.when(F.col("l_linenumber") % 2 == 0, "ん").otherwise("")
    return table(spark, sf_dir, "lineitem").select(picked(_KANA, a).alias("k1"), picked(["", "ん", "っ", ""], a + b).alias("mid"), picked(_KANA, b).alias("k2"), last.alias("k3"), tail.alias("tail"))


_PARTS = f"""pt AS (SELECT '{_KANA}'[l_orderkey % {len(_KANA)} + 1] AS k1, ['', 'ん', 'っ', ''][(l_orderkey + l_partkey) % 4 + 1] AS mid, '{_KANA}'[l_partkey % {len(_KANA)} + 1] AS k2,
 CASE WHEN l_linenumber % 3 = 0 THEN {listed(_YOUON)}[l_suppkey % {len(_YOUON)} + 1] ELSE '{_KANA}'[l_suppkey % {len(_KANA)} + 1] END AS k3, CASE WHEN l_linenumber % 2 = 0 THEN 'ん' ELSE '' END AS tail,
 CASE WHEN l_linenumber % 3 = 0 THEN {listed(_YOUON_HANGUL)}[l_suppkey % {len(_YOUON)} + 1] ELSE '{_HANGUL}'[l_suppkey % {len(_KANA)} + 1] END AS h3 FROM lineitem),
pk AS (SELECT *, translate(k1, '{_KANA}', '{_HANGUL}') AS h1, translate(k2, '{_KANA}', '{_HANGUL}') AS h2 FROM pt)"""


def _closed(h: str, mark: str) -> str:
    """SQL for a syllable with a final as compatible output has it."""
    pairs = kana.OTHER[mark].split()
    step = jamo.FINAL.index(mark) + 1
    return f"CASE WHEN contains('{kana.REGULAR[mark]}', {h}) THEN chr(unicode({h}) + {step}) WHEN contains('{''.join(p[0] for p in pairs)}', {h}) THEN translate({h}, '{''.join(p[0] for p in pairs)}', '{''.join(p[1] for p in pairs)}') ELSE {h} || '{mark}' END"


@query(
    f"""WITH {_PARTS}, x AS (SELECT DISTINCT k1 || mid || k2 || k3 || tail AS reading, CASE mid WHEN 'ん' THEN CASE WHEN contains('{kana.LABIAL}', k2) THEN {_closed("h1", "ㅁ")} ELSE {_closed("h1", "ㄴ")} END WHEN 'っ' THEN {_closed("h1", "ㅅ")} ELSE h1 END
 || h2 || CASE WHEN tail <> '' THEN {_closed("h3", "ㄴ")} ELSE h3 END AS hangul FROM pk) SELECT reading, hangul FROM x"""
)
def q_kana_hangul(spark, sf_dir):
    readings = parts(spark, sf_dir).select(F.concat("k1", "mid", "k2", "k3", "tail").alias("reading")).distinct()
    return readings.select("reading", kana.hangul("reading").alias("hangul"))


@query(f"WITH {_PARTS} SELECT DISTINCT k1 || mid || k2 || k3 || tail AS reading, h1 || translate(mid, 'んっ', 'ⓝⓧ') || h2 || h3 || translate(tail, 'ん', 'ⓝ') AS marked FROM pk")
def q_kana_marked(spark, sf_dir):
    readings = parts(spark, sf_dir).select(F.concat("k1", "mid", "k2", "k3", "tail").alias("reading")).distinct()
    return readings.select("reading", kana.marked("reading").alias("marked"))


@query(f"WITH {_PARTS} SELECT DISTINCT k1 || k3 AS reading, translate(k1, '{kana.VOICED[0]}', '{kana.VOICED[1]}') || k3 AS voiced FROM pk")
def q_voice(spark, sf_dir):
    readings = parts(spark, sf_dir).select(F.concat("k1", "k3").alias("reading")).distinct()
    return readings.select("reading", kana.voice(F.col("reading")).alias("voiced"))


_LONG_UNITS = {p: (kana.YOUON[p[:2]] if len(p) == 3 else kana.KANA[p[0]]) + "~" for p in kana.MARKED_PATTERNS} | {k: kana.KANA[k] for k in "かさたなまやらわじぱ"}


@query(
    f"WITH u AS (SELECT {listed(_LONG_UNITS)}[l_orderkey % {len(_LONG_UNITS)} + 1] AS a, {listed(_LONG_UNITS)}[l_partkey % {len(_LONG_UNITS)} + 1] AS b, {listed(_LONG_UNITS.values())}[l_orderkey % {len(_LONG_UNITS)} + 1] AS x, {listed(_LONG_UNITS.values())}[l_partkey % {len(_LONG_UNITS)} + 1] AS y FROM lineitem) SELECT DISTINCT a || 'ん' || b AS reading, x || 'ㄴ' || y AS hangul FROM u"
)
def q_long_vowel_marks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    readings = li.select(F.concat(picked(_LONG_UNITS, F.col("l_orderkey")), F.lit("ん"), picked(_LONG_UNITS, F.col("l_partkey"))).alias("reading")).distinct()
    return readings.select("reading", kana.lengthened("reading").alias("hangul"))


_LENGTHENING = ["う", "い", "お", "あ", "ー"]


@query(
    f"WITH {_PARTS}, r AS (SELECT k1 || {listed(_LENGTHENING)}[unicode(k2) % 5 + 1] || k3 || 'う' AS reading FROM pk), i AS (SELECT reading, unnest(range(1, length(reading) + 1)) AS i FROM r), p AS (SELECT unnest({listed(kana.LONG_PATTERNS)}) AS pattern) SELECT pattern, count(*) AS n FROM i JOIN p ON starts_with(substr(reading, i::int), pattern) GROUP BY 1"
)
def q_longvowel(spark, sf_dir):
    more = picked(_LENGTHENING, F.ascii("k2"))
    return evaluation.long_vowel_patterns(parts(spark, sf_dir).select(F.concat("k1", more, "k3", F.lit("う")).alias("reading")))


@query(
    f"""WITH {_PARTS}, t AS (SELECT unnest([h1, translate(mid, 'んっ', 'ⓝⓧ'), h2, h3, translate(tail, 'ん', 'ⓝ')]) AS token, unnest([k1, mid, k2, k3, tail]) AS hira FROM pk),
c AS (SELECT token, hira, count(*) AS freq FROM t WHERE token <> '' GROUP BY ALL), p AS (SELECT *, freq / sum(freq) OVER (PARTITION BY token) AS prob FROM c)
SELECT token, hira, freq, prob, (row_number() OVER (PARTITION BY token ORDER BY prob DESC, hira))::int AS rnk FROM p"""
)
def q_marked_map(spark, sf_dir):
    pairs = phonetic.word_counts(parts(spark, sf_dir).select(F.concat("k1", "mid", "k2", "k3", "tail").alias("reading"), F.lit("").alias("hangul")))
    return phonetic.learned(pairs, signs=True)


def plain_pairs(spark, sf_dir) -> DataFrame:
    """reading, hangul, freq of three-syllable words without signs."""
    readings = parts(spark, sf_dir).select(F.concat("k1", "k2", "k3").alias("reading"))
    return phonetic.word_counts(readings.withColumn("hangul", kana.hangul("reading")))


_PAIR_MAP = f"""{_PARTS}, t AS (SELECT unnest([h1, h2, h3, h1 || h2, h2 || h3]) AS token, unnest([k1, k2, k3, k1 || k2, k2 || left(k3, 1)]) AS hira FROM pk),
c AS (SELECT token, hira, count(*) AS freq FROM t GROUP BY ALL), p AS (SELECT *, freq / sum(freq) OVER (PARTITION BY token) AS prob FROM c),
mp AS (SELECT token, hira, freq, prob, (row_number() OVER (PARTITION BY token ORDER BY prob DESC, hira))::int AS rnk FROM p WHERE prob > 5e-3)"""


@query(f"WITH {_PAIR_MAP} SELECT * FROM mp")
def q_pair_map(spark, sf_dir):
    return phonetic.learned(plain_pairs(spark, sf_dir), longest=2)


@query(
    f"""WITH {_PAIR_MAP}, f AS (SELECT token, hira, prob FROM mp WHERE rnk <= 6 AND prob >= 1e-2), w AS (SELECT DISTINCT h1, h2, h3 FROM pk),
x AS (SELECT w.*, a.hira || b.hira || c.hira AS hira, ln(a.prob) + ln(b.prob) + ln(c.prob) AS lp FROM w JOIN f a ON a.token = h1 JOIN f b ON b.token = h2 JOIN f c ON c.token = h3
 UNION ALL SELECT w.*, a.hira || b.hira, ln(a.prob) + ln(b.prob) FROM w JOIN f a ON a.token = h1 || h2 JOIN f b ON b.token = h3
 UNION ALL SELECT w.*, a.hira || b.hira, ln(a.prob) + ln(b.prob) FROM w JOIN f a ON a.token = h1 JOIN f b ON b.token = h2 || h3)
SELECT h1 || h2 || h3 AS hangul, round(max(exp(lp)), 9) AS conf FROM x GROUP BY h1, h2, h3"""
)
def q_decode_beam(spark, sf_dir):
    """The confidence of the best reading; which of equally likely ones it is, is left to tests."""
    pairs = plain_pairs(spark, sf_dir)
    found = decode.candidates(pairs.select("hangul").distinct(), phonetic.learned(pairs, longest=2), width=6, most=1)
    return found.select("hangul", F.round(F.get("candidates", F.lit(0))["conf"], 9).alias("conf"))


_VERBS = [*words.GODAN, *words.IRREGULAR]
_FORMS = {form: {v: (words.IRREGULAR[v] if v in words.IRREGULAR else words.GODAN[v])[i] + tail for v in _VERBS} for form, (i, tail) in words.FORMS.items()}
_STEMS = ["たべ", "か", "よ", "あそ", "つく"]


@query(
    f"""WITH v AS (SELECT {listed(_VERBS)}[l_orderkey % {len(_VERBS)} + 1] AS e, {listed(_STEMS)}[l_partkey % 5 + 1] AS s, l_orderkey % {len(_VERBS)} >= {len(words.GODAN)} AS whole FROM lineitem), f AS (SELECT unnest({listed(_FORMS)}) AS form)
SELECT DISTINCT form, CASE WHEN whole THEN e ELSE s || e END AS reading, CASE WHEN whole THEN '' ELSE s END || CASE {" ".join(f"WHEN form = '{form}' AND e = '{v}' THEN '{x}'" for form, by in _FORMS.items() for v, x in by.items())} END AS conjugated FROM v, f"""
)
def q_conjugate(spark, sf_dir):
    i = F.col("l_orderkey") % len(_VERBS)
    ends = picked(_VERBS, F.col("l_orderkey"))
    reading = F.when(i >= len(words.GODAN), ends).otherwise(F.concat(picked(_STEMS, F.col("l_partkey")), ends))
    verbs = table(spark, sf_dir, "lineitem").select(reading.alias("reading")).distinct()
    forms = F.array(*[F.struct(F.lit(f).alias("form"), words.conjugated(F.col("reading"), f).alias("conjugated")) for f in words.FORMS])
    return verbs.select("reading", F.inline(forms)).select("form", "reading", "conjugated")


_ENDS = ["ます", "した", "して", "ない", "った", "いた", "んだ", "いで", "です", "いです", "い", "る", "は", "から"]


@query(
    f"""WITH w AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '{_KANA}'[l_orderkey % {len(_KANA)} + 1] END AS k, {listed(_ENDS)}[l_suppkey % {len(_ENDS)} + 1] AS e FROM lineitem), s AS (SELECT k || e AS w FROM w)
SELECT CASE WHEN w IN ('は', 'が', 'を', 'に', 'で', 'と', 'の', 'も', 'から', 'まで', 'より', 'へ') THEN 'particle' WHEN regexp_matches(w, '(ます|した|して|ない|った|いた|んだ|いで)$') THEN 'verb' WHEN regexp_matches(w, 'いです$') THEN 'adjective'
 WHEN regexp_matches(w, 'です$') THEN 'auxiliary' WHEN regexp_matches(w, '.い$') THEN 'adjective' ELSE 'noun' END AS wtype, count(*) AS n FROM s GROUP BY 1"""
)
def q_word_class(spark, sf_dir):
    lead = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(picked(_KANA, F.col("l_orderkey")))
    word = F.concat(lead, picked(_ENDS, F.col("l_suppkey")))
    return table(spark, sf_dir, "lineitem").groupBy(words.word_class(word, word).alias("wtype")).agg(F.count("*").alias("n"))


# Syllables of one reading each that begin with a consonant.
_CV = {r: k for r, k in romaji.BASE.items() if len(r) == 2 and r[1] in "aiueo" and r[0] in "kgsztdhbpmr"}


@query(
    f"""WITH u AS (SELECT {listed(_CV)}[l_orderkey % {len(_CV)} + 1] AS a, {listed(_CV)}[l_partkey % {len(_CV)} + 1] AS b, {listed(_CV.values())}[l_orderkey % {len(_CV)} + 1] AS x, {listed(_CV.values())}[l_partkey % {len(_CV)} + 1] AS y, l_suppkey % 4 AS m FROM lineitem)
SELECT DISTINCT a || CASE m WHEN 0 THEN 'n' WHEN 1 THEN b[1] ELSE '' END || b || CASE m WHEN 2 THEN 'n' ELSE '' END AS romaji, x || CASE m WHEN 0 THEN 'ん' WHEN 1 THEN 'っ' ELSE '' END || y || CASE m WHEN 2 THEN 'ん' ELSE '' END AS hiragana FROM u"""
)
def q_romaji_hiragana(spark, sf_dir):
    a, b, m = picked(_CV, F.col("l_orderkey")), picked(_CV, F.col("l_partkey")), F.col("l_suppkey") % 4
    text = F.concat(a, F.when(m == 0, "n").when(m == 1, F.left(b, F.lit(1))).otherwise(""), b, F.when(m == 2, "n").otherwise(""))
    return table(spark, sf_dir, "lineitem").select(text.alias("romaji")).distinct().select("romaji", romaji.hiragana("romaji").alias("hiragana"))


def _weights(rows) -> str:
    return "VALUES " + ", ".join(f"({i}, '{t}', {w!r}::double)" for i, of in enumerate(rows) for t, w in of)


@query(
    f"""WITH c(i, t, w) AS ({_weights(romaji.INITIALS)}), v(i, t, w) AS ({_weights(romaji.VOWELS)}), s AS (SELECT DISTINCT (l_orderkey % 11172)::int AS n FROM lineitem),
x AS (SELECT n, c.t || v.t AS t, c.w * v.w AS w FROM s JOIN c ON c.i = n // 588 JOIN v ON v.i = n % 588 // 28)
SELECT chr(44032 + n) AS ch, round(max(w), 9) AS best, max(t LIKE '%a') AS with_a FROM x GROUP BY n"""
)
def q_romaji_readings(spark, sf_dir):
    """The best weight among the romaji of a syllable, and whether one has the vowel a; the order of equal ones is left to tests."""
    ch = jamo.code_point(F.expr("44032 + l_orderkey % 11172"))
    found = table(spark, sf_dir, "lineitem").select(ch.alias("ch")).distinct().withColumn("r", romaji.romaji_readings("ch", F.lit(30)))
    vowel = F.exists("r", lambda x: F.regexp_like(x["romaji"], F.lit("a(n|m|ng|Q)?$")))
    return found.select("ch", F.round(F.array_max(F.transform("r", lambda x: x["conf"])), 9).alias("best"), vowel.alias("with_a"))


_CONSONANTS = [c for c in jamo.INITIAL if c in jamo.FINAL]


@query(
    f"""WITH u AS (SELECT {listed(_CONSONANTS)}[l_orderkey % {len(_CONSONANTS)} + 1] AS a, '{"".join(jamo.MEDIAL)}'[l_partkey % 21 + 1] AS b, {listed(_CONSONANTS)}[l_suppkey % {len(_CONSONANTS)} + 1] AS c, l_linenumber % 2 = 0 AS closed FROM lineitem),
s AS (SELECT DISTINCT *, list_position({listed(jamo.INITIAL)}, a) - 1 AS i, list_position({listed(jamo.MEDIAL)}, b) - 1 AS m, list_position({listed(jamo.INITIAL)}, c) - 1 AS j, list_position({listed(jamo.FINAL)}, c) AS f FROM u)
SELECT a || b || c || CASE WHEN closed THEN '' ELSE 'ㅏ' END AS letters, CASE WHEN closed THEN chr((44032 + (i * 21 + m) * 28 + f)::int) ELSE chr((44032 + (i * 21 + m) * 28)::int) || chr((44032 + j * 588)::int) END AS text FROM s"""
)
def q_jamo_letters(spark, sf_dir):
    """A consonant closes a syllable at the end, and begins the next one before a vowel."""
    tail = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("ㅏ")
    letters = F.concat(picked(_CONSONANTS, F.col("l_orderkey")), picked(jamo.MEDIAL, F.col("l_partkey")), picked(_CONSONANTS, F.col("l_suppkey")), tail)
    return table(spark, sf_dir, "lineitem").select(letters.alias("letters")).distinct().select("letters", jamo.composed("letters").alias("text"))
