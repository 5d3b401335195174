import numpy as np
import pytest
from pyspark.sql import functions as F

from moraline.operators import decode, dictionary, phonetic, ranking, sentence, vectors


@pytest.fixture(scope="module")
def table(spark):
    pairs = spark.createDataFrame([("つくば", "츠쿠바", 100), ("ちかく", "치카쿠", 50), ("つき", "츠키", 80)], "reading string, hangul string, freq long")
    return phonetic.learned(pairs).cache()


def test_alignment():
    assert phonetic.aligned_pairs("つくば", "츠쿠바") == [("츠", "つ"), ("쿠", "く"), ("바", "ば")]
    assert phonetic.aligned_pairs("きょう", "쿄우") == [("쿄", "きょ"), ("우", "う")]
    assert phonetic.aligned_pairs("", "쿄우") == []


def test_learned_map(table):
    top = {r.token: r.hira for r in table.where("rnk = 1").collect()}
    assert top["츠"] == "つ" and top["치"] == "ち"
    stats = phonetic.map_stats(table).first()
    assert stats.tokens == stats.mappings == 6 and stats.max_ambiguity == 1


def test_multitoken_map(spark):
    pairs = spark.createDataFrame([("さくら", "사쿠라", 2)], "reading string, hangul string, freq long")
    got = {(r.token, r.hira, r.freq) for r in phonetic.learned(pairs, longest=3).collect()}
    assert got == {("사", "さ", 2), ("쿠", "く", 2), ("라", "ら", 2), ("사쿠", "さく", 2), ("쿠라", "くら", 2), ("사쿠라", "さくら", 2)}
    signs = {(r.token, r.hira) for r in phonetic.learned(spark.createDataFrame([("きって", "x", 1)], "reading string, hangul string, freq long"), signs=True).collect()}
    assert signs == {("키", "き"), ("ⓧ", "っ"), ("테", "て")}


def test_probabilities_sum_to_one_before_the_floor(spark):
    pairs = spark.createDataFrame([("か", "가", 3), ("が", "가", 1)], "reading string, hangul string, freq long")
    got = [(r.hira, r.prob, r.rnk) for r in phonetic.learned(pairs).orderBy("rnk").collect()]
    assert got == [("か", 0.75, 1), ("が", 0.25, 2)]


def test_augmented_map(spark, table):
    got = phonetic.augmented(table, 1000)
    assert got.where("token = '코~'").first().hira == "こう" and got.where("token = '츠' and rnk = 1").count() == 1


def test_alignment_with_signs():
    """A sign without its kana, and such kana without a sign, are passed over."""
    of = lambda r, h: [(h[s], r[a:b]) for a, b, s in phonetic.marked_units(r, h)]
    assert of("きっ", "키ⓝⓧ") == [("키", "き"), ("ⓧ", "っ")]
    assert of("かんき", "카키") == [("카", "か"), ("키", "き")]
    assert of("きょう", "쿄우") == [("쿄", "きょ"), ("우", "う")] and of("きょう", "키x우")[:2] == [("키", "き"), ("x", "ょ")]
    assert of("らー", "라ⓜⓜ") == [("라", "ら"), ("ⓜ", "ー")] and of("", "ⓝ") == []


def test_marker_map(spark):
    empty = spark.createDataFrame([], "token string, hira string, freq long, prob double, rnk int")
    got = {r.token: (r.hira, r.freq, r.prob, r.rnk) for r in phonetic.augmented(empty, 250).collect()}
    assert len(got) == 56 and got["쿄~"] == ("きょう", 2, 0.95, 1) and got["이~"][0] == "いい" and "카~" not in got


def test_hybrid():
    one = {"가": [("か", 1.0)], "강": [("か", 1.0)], "각": [("か", 1.0)], "토": [("と", 1.0)], "우": [("う", 1.0)]}
    assert decode.hybrid("강", one) == [("か", 1.0), ("かん", 0.7)]
    assert decode.hybrid("각가", one) == [("かか", 1.0), ("かっか", 0.6)]
    assert decode.hybrid("토우", one) == [("とう", 1.0), ("とー", 0.5)]
    assert decode.hybrid("가", one, original="갚") == [("か", 1.0)] and decode.hybrid("가가", one, original="가간") == [("かか", 1.0)]
    finals = {f: decode.variants("か", chr(0xAC00 + f))[:1] for f in range(28)}
    assert {f for f, v in finals.items() if v == [("かん", 0.7)]} == {2, 6, 21} and {f for f, v in finals.items() if v == [("かっ", 0.6)]} == {1, 7, 9, 10, 17}


def test_beam(table):
    m = decode.collected(table)
    assert decode.beam("츠쿠바", m)[0][0] == "つくば"
    assert decode.beam("", m) == []
    got = decode.beam("A", {})
    assert got[0][0] == "A" and got[0][1] == pytest.approx(np.exp(-20))


CASES = "와→は|나마에와→なまえは|곤니찌와→こんにちわ|가→が|이로가→いろが|도쿄→ときょ|도쿄~→ときょう|세~→せい|카^→が|교토^→きょど|카^~→があ|카~^→があ|사쿠라~→さくらあ|데스카→ですか|난데스카→なんですか|마스→ます|나마에와 난데스카→なまえは なんですか"


@pytest.mark.parametrize("case", CASES.split("|"))
def test_sentences_without_map(case):
    a, b = case.split("→")
    assert decode.sentence(a, {}, width=6, most=5) == b


def test_frames(spark, table):
    df = spark.createDataFrame([(1, "츠쿠바"), (2, None), (3, "츠키")], "id long, hangul string")
    a = {r.id: r.candidates for r in decode.candidates(df, table).collect()}
    b = {r.id: r.candidates for r in decode.decode_by_join(df, table).collect()}
    assert a[1][0].hira == b[1][0].hira == "つくば" and a[3] == b[3] and a[2] is None
    one = decode.sentences(df, table).where("id = 1").first()
    assert one.decoded == "つくば"


def test_fold_equals_beam(spark):
    m = {"a": [("x", 0.6), ("y", 0.4)], "b": [("p", 0.7), ("q", 0.3)]}
    lookup = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in v]))])
    df = spark.createDataFrame([("abba",), ("ab?",), ("",)], "w string").withColumn("lookup", lookup)
    for r in df.select("w", decode.fold(F.col("w"), F.col("lookup"), 2, 5).alias("f")).collect():
        want = [h for h, _ in decode.beam(r.w.replace("?", "?"), m, 2, 5)] if r.w else [""]
        assert [x.h for x in r.f] == want


def test_rule_based():
    assert "さくら" in [h for h, _, _ in decode.rule_based("사쿠라")]


def vec(spark, d):
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in d.items()], "word string, vector array<float>")


A = {"花見": [0.9, 0.1, 0, 0], "風邪": [0, 0, 0.9, 0.1], "花": [0.8, 0.2, 0, 0], "鼻": [0, 0, 0.8, 0.2]}


@pytest.mark.parametrize("context,want", [(["花見"], "花"), (["風邪"], "鼻"), ([], "花")])
def test_ranking_by_context(spark, context, want):
    entries = spark.createDataFrame([("はな", "花", 5000), ("はな", "鼻", 3000)], "reading string, surface string, frequency long")
    cands = spark.createDataFrame([(1, "はな", 0.9)], "id long, hira string, conf double")
    ctx = spark.createDataFrame([(1, context)], "id long, words array<string>")
    got = ranking.ranked(cands, entries, ctx, vec(spark, A), 5000).orderBy("rank").collect()
    assert got[0].surface == want and {r.surface for r in got} == {"花", "鼻", "はな"}


def test_reading_and_directional_ranking(spark):
    cands = spark.createDataFrame([(1, "花", 0.5), (1, "鼻", 0.6)], "id long, hira string, conf double")
    ctx = spark.createDataFrame([(1, ["花見"])], "id long, words array<string>")
    assert ranking.ranked_readings(cands, ctx, vec(spark, A)).orderBy("rank").first().surface == "花"
    both = {f"{m}:{w}": v for m in "FB" for w, v in A.items()}
    none = spark.createDataFrame([], "reading string, surface string, frequency long")
    empty = spark.createDataFrame([(1, [])], "id long, words array<string>")
    assert ranking.ranked_directional(cands, none, ctx, empty, vec(spark, both)).orderBy("rank").first().surface == "花"


def test_candidate_window(spark):
    entries = spark.createDataFrame([("こうえん", s, f) for s, f in (("公園", 1000), ("講演", 500), ("後援", 100))], "reading string, surface string, frequency long")
    cands = spark.createDataFrame([(1, "こうえん", 0.8)], "id long, hira string, conf double")
    got = [r.surface for r in ranking.converted(cands, entries, 1000).orderBy("rank").collect()]
    assert got == ["公園", "こうえん", "講演", "後援"]


B = {"花": [0.85, 0.15, 0.05, 0], "桜": [0.9, 0.1, 0, 0], "花見": [0.8, 0.2, 0, 0], "風": [0.7, 0.3, 0, 0], "鼻": [0.05, 0, 0.85, 0.15], "風邪": [0, 0.05, 0.8, 0.2], "頭": [0, 0, 0.75, 0.25], "痛い": [0, 0, 0.7, 0.3], "が": [0.25] * 4, "を": [0.25] * 4}
DICT = [("はな", "花", 8000), ("はな", "鼻", 5000), ("かぜ", "風", 6000), ("かぜ", "風邪", 5000)]


def buffer(committed=()):
    return sentence.SentenceBuffer({w: np.array(v, np.float32) for w, v in B.items()}, list(committed))


def segment(hangul, reading):
    own = [(s, r, 0.9, f) for r, s, f in DICT if r == reading]
    return sentence.Segment(hangul, own + [(reading, reading, 0.9, 0)])


def test_retroactive_choice():
    b = buffer()
    b.add(segment("하나", "はな"))
    assert b.composed() == "花"
    b.add(segment("카제", "かぜ"))
    assert [s.surface() for s in b.segments] == ["鼻", "風邪"]
    b.pop()
    assert b.composed() == "花"


def test_committed_context_and_pinning():
    b = buffer(["桜"])
    b.add(segment("하나", "はな"))
    assert b.composed() == "花"
    assert b.commit() == "花" and b.committed == ["桜", "花"] and b.segments == []
    b = buffer()
    b.add(segment("하나", "はな"))
    b.add(segment("카제", "かぜ"))
    at = next(i for i, r in enumerate(b.segments[0].ranked) if r[1] == "花")
    b.select(0, at)
    assert b.segments[0].surface() == "花"
    b.segments[0].turn(1)
    assert b.composed("[{}]").startswith("[")


def test_sentences_as_frames(spark):
    entries = spark.createDataFrame(DICT, "reading string, surface string, frequency long")
    segs = spark.createDataFrame([(1, 0, "하나", [("はな", 0.9)]), (1, 1, "카제", [("かぜ", 0.9)]), (2, 0, "하나", [("はな", 0.9)])], "sid long, pos int, hangul string, candidates array<struct<hira:string,conf:double>>")
    got = {(r.sid, r.pos): r.surface for r in sentence.reranked(segs, entries, vec(spark, B)).collect()}
    assert got == {(1, 0): "鼻", (1, 1): "風邪", (2, 0): "花"}
    past = spark.createDataFrame([(2, ["頭", "痛い"])], "sid long, words array<string>")
    got = {(r.sid, r.pos): r.surface for r in sentence.reranked(segs, entries, vec(spark, B), past).collect()}
    assert got[2, 0] == "鼻"


def test_dictionary(spark):
    rows = spark.createDataFrame([("さくら", "桜", 5000), ("さくら", "櫻", 100), ("さくらんぼ", "桜ん坊", 50), ("さけ", "酒", 70)], "reading string, surface string, frequency long")
    assert [r.surface for r in dictionary.lookup(rows, "さくら").collect()] == ["桜", "櫻"]
    assert dictionary.by_prefix(rows, "さく").count() == 3 and dictionary.by_prefix(rows, "さくら", strict=True).first().surface == "桜ん坊"
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "k string, v string, seq long")
    assert {(r.k, r.v) for r in dictionary.last_wins(log, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}
    seq = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabba")], "g long, i long, s string")
    assert [r.s for r in dictionary.consecutive_distinct(seq, ["g"], [F.col("i")], "s").orderBy("i").collect()] == ["a", "b", "a"]


def test_vectors(spark):
    df = vec(spark, {"a": [1, 2, 3], "b": [3, 4, 5]})
    assert vectors.centroids(df.withColumn("g", F.lit(1)), ["g"]).first().vector == [2, 3, 4]
    w = spark.createDataFrame([(1, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 1.0)], "g long, vector array<float>, w double")
    assert vectors.centroids(w, ["g"], weight=F.col("w")).first().vector == [0.75, 0.25]
    one = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, c array<float>, d array<float>")
    got = one.select(*(vectors.cosine(F.col("a"), F.col(x)) for x in "abcd")).first()
    assert tuple(got) == pytest.approx((1, 0, -1, 0))
    back = df.select("vector", vectors.from_bytes(vectors.to_bytes("vector")).alias("v")).collect()
    assert all(r.v == r.vector for r in back)


def test_training(spark):
    edges = spark.createDataFrame([("桜", "花", 8.0), ("花", "見", 4.0), ("風", "邪", 2.0)], "a string, b string, x double")
    edges = edges.union(edges.select("b", "a", "x"))
    got = {r.word: np.array(r.vector) for r in vectors.trained(edges, 16, 20).collect()}
    assert len(got) == 5 and all(abs(np.linalg.norm(v) - 1) < 0.01 and len(v) == 16 for v in got.values())


def test_training_follows_its_definition(spark):
    """One edge by hand: the loss before the first step, and the step itself."""
    import pandas as pd

    words, _, losses = vectors.descent(pd.DataFrame({"a": ["a"], "b": ["b"], "x": [4.0]}), 2, 2, 0.05)
    v = vectors.start(2, 2).astype(float)
    f, off = (4 / 10) ** 0.75, v[0] @ v[1] - np.log(4)
    g = 2 * 0.05 * f * off
    after = (v[0] - g * v[1]) @ (v[1] - g * v[0]) - 2 * g - np.log(4)
    assert words == ["a", "b"] and losses == pytest.approx([f * off**2, f * after**2], rel=1e-4)
    edges = spark.createDataFrame([("a", "b", 4.0)], "a string, b string, x double")
    assert [r.loss for r in vectors.training_loss(edges, 2, 2).orderBy("round").collect()] == pytest.approx(losses)


def test_large_tables_are_not_trained_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(vectors, "EDGES", 1)
    with pytest.raises(ValueError, match="factorised"):
        vectors.trained(spark.createDataFrame([("a", "b", 4.0), ("a", "c", 4.0)], "a string, b string, x double"))


def test_factors_have_their_own_numbers(spark):
    edges = spark.createDataFrame([(f"w{i}", f"w{i + 1}", 3.0) for i in range(400)], "a string, b string, x double")
    ids = vectors.numbered(edges.select(F.col("a").alias("word")).union(edges.select("b"))).collect()
    assert sorted(r.id for r in ids) == list(range(401)) and len({r.word for r in ids}) == 401
    assert vectors.factorised(edges, 4, 2).count() == 401


def test_topk_of_words_of_any_length(spark, tmp_path):
    """Brute force over all readings of every word; all lengths are decoded."""
    import collections
    import itertools
    import math

    from moraline.plans import catalogue

    text = "a á à b é e ab áb eá bea béa abea ábeà aebéo oóbeaáé"
    spark.createDataFrame([(1, text), (2, "e b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = str.maketrans(catalogue.ACCENTED, catalogue.PLAIN)
    n = collections.Counter(text + "e b")
    total = collections.Counter()
    for c, k in n.items():
        total[c.translate(plain)] += k
    want = {}
    for w in {w.translate(plain) for w in text.split()}:
        options = [[(c, math.log(k / total[x])) for c, k in n.items() if c.translate(plain) == x and k / total[x] >= 0.01] for x in w]
        all_ = [("".join(c for c, _ in s), sum(lp for _, lp in s)) for s in itertools.product(*options)]
        want[w] = [(d, round(lp, 6)) for d, lp in sorted(all_, key=lambda s: (-round(s[1], 9), s[0]))[:5]]
    got = collections.defaultdict(list)
    for r in catalogue.QUERIES["q_decode_topk_all"](spark, str(tmp_path)).orderBy("plain", "rank").collect():
        got[r.plain].append((r.decoded, r.lp))
    assert {1, 2, 3, 4, 5, 7} == {len(w) for w in got} and got.keys() == want.keys()
    assert all([d for d, _ in got[w]] == [d for d, _ in want[w]] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[w], want[w])) for w in want)


def test_too_many_surfaces(spark, table, monkeypatch):
    rows = spark.createDataFrame([("츠쿠바",)], "hangul string")
    surfaces = spark.createDataFrame([(f"r{i}", f"s{i}", i) for i in range(table.count() + 1)], "reading string, surface string, load_seq long")
    monkeypatch.setattr(decode, "LIMIT", table.count())
    with pytest.raises(ValueError, match="surfaces"):
        decode.sentences(rows, table, surfaces=surfaces)
