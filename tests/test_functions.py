import pytest
from pyspark.sql import functions as F

from moraline.functions import jamo, kana, romaji, words

KANA = "さくら→사쿠라 とうきょう→토우쿄우 がっこう→갓코우 きって→킷테 まっすぐ→맛스구 しゃしん→샤신 ちゅうがく→추우가쿠 しんかんせん→신칸센 さんぽ→삼포 しんぶん→심분 すみません→스미마센 わをん→와온 せん→센 んあ→ㄴ아 いっぱい→잇파이 あった→앗타 こんにちは→콘니치하 りんご→리ㄴ고 みんな→미ㄴ나"
ROMAJI = "shi→し fu→ふ kka→っか tta→った sakura→さくら tokyo→ときょ kanda→かんだ shinbun→しんぶん konnichiwa→こんにちわ onna→おんな sennin→せんにん annai→あんない"


@pytest.mark.parametrize("case", KANA.split())
def test_kana_to_hangul(case):
    a, b = case.split("→")
    assert kana.to_hangul(a) == b


def test_exact_composition_closes_every_syllable():
    assert kana.to_hangul("りんご", compat=False) == "린고"
    assert kana.to_hangul("") == "" and kana.to_hangul("abc") == "abc"


@pytest.mark.parametrize("case", ROMAJI.split())
def test_romaji_to_hiragana(case):
    a, b = case.split("→")
    assert romaji.to_hiragana(a) == b


@pytest.mark.parametrize("case", "아:a 카:ka 사:sa 시:shi 추:chu,tsu 나:na 사쿠라:sakura 니혼:nihon 도쿄:tokyo 찌:chi 와:wa".split())
def test_romaji_readings(case):
    a, b = case.split(":")
    found = [r for r, _ in romaji.readings(a, 20)]
    assert set(b.split(",")) <= set(found)


def test_other_characters_have_weight_zero():
    assert romaji.candidates("A") == [("A", 0.0)] and romaji.readings("", 5) == []


@pytest.mark.parametrize("case", "곤:こん,ごん 산:さん 킨:きん 갇:かっ 찌:ち 와:わ".split())
def test_fallback(case):
    a, b = case.split(":")
    assert set(b.split(",")) <= {r for r, _ in romaji.fallback(a)}


def test_jamo_columns(spark):
    df = spark.createDataFrame([("한",), ("가",), ("A",), ("あ",)], "ch string")
    got = {r.ch: (tuple(r.j) if r.j else None, r.back) for r in df.withColumn("j", jamo.decompose(F.col("ch"))).withColumn("back", jamo.compose(F.col("j.cho"), F.col("j.jung"), F.col("j.jong"))).collect()}
    assert got == {"한": ((18, 0, 4), "한"), "가": ((0, 0, 0), "가"), "A": (None, None), "あ": (None, None)}


def test_letters(spark):
    row = spark.range(1).select(jamo.initial(F.lit(18)).alias("a"), jamo.medial(F.lit(0)).alias("b"), jamo.final(F.lit(4)).alias("c"), jamo.final(F.lit(0)).alias("d"), jamo.typed(F.lit("gksRmf")).alias("e")).first()
    assert tuple(row) == ("ㅎ", "ㅏ", "ㄴ", "", "ㅎㅏㄴㄲㅡㄹ")


@pytest.mark.parametrize("letters,text", [("ㅎㅏㄴㄱㅡㄹ", "한글"), ("ㄷㅏㄹㄱㅣ", "달기"), ("ㄷㅏㄹㄱ", "닭"), ("ㅗㅏ", "ㅘ"), ("ㄱ", "ㄱ"), ("", ""), ("ㄱㅗㅏ", "과")])
def test_composition(letters, text):
    assert jamo.compose_letters(letters) == text


def test_single_finals():
    assert jamo.compose_letters("ㄷㅏㄹㄱ", final_pairs=False) == "달ㄱ"


@pytest.mark.parametrize("form,cases", {"masu": "いく→いきます たべる→たべます する→します くる→きます", "te": "いく→いって たべる→たべて する→して", "ta": "いく→いった たべる→たべた する→した", "nai": "いく→いかない たべる→たべない する→しない"}.items())
def test_conjugation(spark, form, cases):
    pairs = [c.split("→") for c in cases.split()]
    df = spark.createDataFrame(pairs, "reading string, want string").withColumn("got", words.conjugated(F.col("reading"), form))
    for r in df.collect():
        assert r.got == r.want == words.conjugate(r.reading, form)


def test_marks(spark):
    assert kana.to_marked("がっこうんー") == "가ⓧ코우ⓝⓜ"
    assert kana.with_marks("とうきょう") == "토~쿄~"
    assert [p for _, p in kana.long_vowels("せんせい")] == ["せい"]
    row = spark.range(1).select(kana.voice(F.lit("かさ")).alias("a"), kana.extension(F.lit("そ")).alias("b"), kana.extension(F.lit("ん")).alias("c")).first()
    assert tuple(row) == ("がさ", "う", None)


def test_long_vowels():
    for pattern in kana.LONG_PATTERNS:
        assert kana.long_vowels("ん" + pattern) == [(1, pattern)]
    assert kana.long_vowels("とうきょうー") == [(0, "とう"), (2, "きょう"), (5, "ー")] and kana.long_vowels("ちいさい") == kana.long_vowels("かあさん") == []
    for pattern in kana.MARKED_PATTERNS:
        assert kana.with_marks(pattern) == kana.to_hangul(pattern[:-1]) + "~"
    assert kana.with_marks("ちいさい") == "치이사이" and kana.with_marks("かあさん") == "카아사ㄴ" and kana.with_marks("ーああ") == "아~"


@pytest.mark.parametrize(
    "surface,reading,want",
    [
        ("は", "は", "particle"), ("から", "から", "particle"), ("犬", "いぬ", "noun"), ("食べます", "たべます", "verb"), ("行った", "いった", "verb"), ("読んだ", "よんだ", "verb"), ("泳いで", "およいで", "verb"),
        ("行かない", "いかない", "verb"), ("学生です", "がくせいです", "adjective"), ("花です", "はなです", "auxiliary"), ("赤いです", "あかいです", "adjective"), ("赤い", "あかい", "adjective"), ("い", "い", "noun"), ("食べる", "たべる", "noun"),
    ],
)
def test_word_classes(spark, surface, reading, want):
    assert spark.range(1).select(words.word_class(F.lit(surface), F.lit(reading)).alias("c")).first().c == want


def test_fallback_table(spark):
    table = romaji.fallback_table()
    assert len(table) == 11_172 and all(len(v) <= 8 for v in table.values()) and romaji.fallback("A") == ()
    got = {(r.token, r.rnk): r.hira for r in romaji.fallback_frame(spark).where("token = '갇'").collect()}
    assert got["갇", 1] == "かっ"


def test_pieces_join_to_the_text(spark):
    text = " a  b\tc "
    row = spark.createDataFrame([(text,)], "t string").select(F.array_join(words.pieces(F.col("t")), "").alias("p")).first()
    assert row.p == text


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    got = df.select(kana.hangul("t").alias("a"), romaji.hiragana("t").alias("b"), jamo.composed("t").alias("c")).collect()
    assert tuple(got[0]) == (None, None, None) and tuple(got[1]) == ("", "", "")


def test_registered_functions(spark):
    from moraline.functions import registry

    assert set(registry.register(spark)) == {*registry.FUNCTIONS, *registry.TABLE_FUNCTIONS}
    assert spark.sql("SELECT kana_to_hangul('さくら') AS a, romaji_to_hiragana('sakura') AS b").first() == ("사쿠라", "さくら")
    assert "さくら" in {r.hira for r in spark.sql("SELECT * FROM rule_readings('사쿠라', 10)").collect()}
    assert [tuple(r) for r in spark.sql("SELECT w, at, pattern FROM VALUES ('とう'), ('か') AS t(w), LATERAL long_vowels(w)").collect()] == [("とう", 0, "とう")]
    assert {"こん", "ごん"} <= {r.hira for r in spark.sql("SELECT * FROM fallback_readings('곤')").collect()}
