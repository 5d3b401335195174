import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraline.operators import asked, autocomplete, cooccurrence, evaluation, ngram, places
from moraline.plans import catalogue
from moraline.sources import generator, readers


def sents(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "sid long, words array<string>")


def test_ngrams(spark, tmp_path):
    m = ngram.NgramModel.build(sents(spark, [["東京", "は", "大きい"], ["東京", "の", "天気"]]))
    assert m.uni.where("word = '東京'").first()["count"] == 2 and m.total == 8
    keys = spark.createDataFrame([(None, "東京", "は"), (None, "東京", "の"), (None, "x", "は"), (None, None, "は")], "w2 string, w1 string, word string")
    got = {(r.w1, r.word): r.p for r in m.counted(keys).withColumn("p", m.p_bigram()).collect()}
    assert got["東京", "は"] == pytest.approx(got["東京", "の"]) and got["x", "は"] == got[None, "は"]
    m.save(str(tmp_path / "m"))
    n = ngram.NgramModel.load(spark, str(tmp_path / "m"))
    assert n.total == m.total and n.weights == m.weights and n.tri.count() == m.tri.count()
    assert m.merged(n).total == 16


def test_trigram_context(spark):
    m = ngram.NgramModel.build(sents(spark, [["今日", "の", "天気"]] * 100 + [["今日", "の", "料理"]]))
    keys = spark.createDataFrame([("今日", "の", "天気"), ("今日", "の", "料理")], "w2 string, w1 string, word string")
    got = {r.word: (r.score, r.norm_score) for r in m.scored(keys).collect()}
    assert got["天気"][0] > 5 * got["料理"][0] and all(0 < x[1] <= 1 for x in got.values())


def test_trigrams_travel_as_pieces(spark, tmp_path, monkeypatch):
    """Every count against Python's, over odd texts and many pieces, and far less than strings to shuffle."""
    rng = random.Random(2)
    names = ["a", "b", "é漢", "x" * 300, "c\u00a0d", "<bos>", "ÀB", "İ"]
    rows = [(i, rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", " \r\n "]).join(rng.choice(names) for _ in range(rng.randrange(60)))) for i in range(700)] + [(900, None), (901, ""), (902, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    split = [[ngram.BOS, *r.words] for r in catalogue.docs(spark, str(tmp_path)).collect() if r.words is not None]
    uni = collections.Counter(w for s in split for w in s)
    at = [((None, None, *s)[i], (None, None, *s)[i + 1], w) for s in split for i, w in enumerate(s)]
    tri, bi = collections.Counter(at), collections.Counter((b, c) for _, b, c in at)
    monkeypatch.setattr(places, "FLUSH", 3000)
    text = docs.where("text is not null").select(F.lower("text").alias("text"))
    assert {r.word: r["count"] for r in places.vocabulary(text, ngram.BOS).collect()} == uni
    got = {(r.w2, r.w1, r.word): (r.n, r.pair) for r in places.counted(text, uni.total(), ngram.BOS).collect()}
    assert {k: n for k, (n, _) in got.items()} == tri and all(p == bi[k[:2]] for k, (_, p) in got.items() if k[0] is not None)
    p = {(r.w2, r.w1, r.word): r.p for r in catalogue.QUERIES["q_p_trigram"](spark, str(tmp_path)).collect()}
    v, t = 0.1 * len(uni), uni.total()
    smooth = lambda w2, w1, w: (uni[w] + 0.1) / (t + v) if w1 is None else (bi[w1, w] + 0.1) / (uni[w1] + v) if w2 is None else (tri[w2, w1, w] + 0.1) / (bi[w2, w1] + v)
    assert p == {k: pytest.approx(smooth(*k), abs=2e-9) for k in tri}
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    catalogue.QUERIES["q_p_trigram"](spark, SMALL).write.format("noop").mode("overwrite").save()
    assert written() - before < 4 * os.path.getsize(f"{SMALL}/documents.parquet")


def shuffled(spark, run):
    """Bytes that a run writes to shuffle files."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = total()
    run()
    return total() - before


def odd_documents(spark, path):
    rng = random.Random(3)
    names = ["a", "b", "é漢", "x" * 300, "c\u00a0d", "<bos>", "ÀB", "İ"]
    rows = [(i, rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n", " \r\n "]).join(rng.choice(names) for _ in range(rng.randrange(60)))) for i in range(700)] + [(900, None), (901, ""), (902, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    split = [[ngram.BOS, *r.words] for r in catalogue.docs(spark, str(path)).collect() if r.words is not None]
    uni = collections.Counter(w for s in split for w in s)
    at = [((None, None, *s)[i], (None, None, *s)[i + 1], w) for s in split for i, w in enumerate(s)]
    return uni, collections.Counter((b, c) for _, b, c in at if b is not None), collections.Counter(at)


def test_keys_with_equal_first_hashes():
    """Second hashes tell them apart; one row of each key leads."""
    rng = np.random.default_rng(4)
    key, more, n = rng.integers(0, 9, 300).astype(np.uint64), rng.integers(0, 5, 300).astype(np.uint16), rng.integers(1, 9, 300)
    total, leads = asked._totals(key, more, n)
    same = (key[:, None] == key) & (more[:, None] == more)
    assert (total == (same * n).sum(1)).all() and leads.sum() == len(set(zip(key.tolist(), more.tolist(), strict=True))) and (same[leads][:, leads] == np.eye(leads.sum())).all()


def test_slices_ask_for_counts(spark, tmp_path, monkeypatch):
    """Every count against Python's, over odd texts, many slices and owners."""
    uni, bi, tri = odd_documents(spark, tmp_path)
    monkeypatch.setattr(asked, "SLICE", 3000)
    got = asked.counted(catalogue.lowered(spark, str(tmp_path)), ngram.BOS)
    assert (got.total, got.vocabulary) == (uni.total(), len(uni))
    rows = [tuple(r) for r in got.places().select("w2", "w1", "word", "c1", "c2", "c3", "h1", "h2").collect()]
    assert sorted(rows, key=str) == sorted(((a, b, c, uni[c], bi[b, c], n * (a is not None), uni[b], bi[a, b]) for (a, b, c), n in tri.items()), key=str)


@pytest.mark.parametrize("name, places_kept", [("q_norm_score", 6), ("q_interp_score", 9)])
def test_scores_shuffle_no_strings(spark, tmp_path, name, places_kept):
    """Scores are those of the count tables, and far less than strings is shuffled."""
    odd_documents(spark, tmp_path)
    m = catalogue.model(spark, str(tmp_path))
    keys = ngram.spans(catalogue.docs(spark, str(tmp_path))).select("w2", "w1", "word").distinct()
    want = {(r.w2, r.w1, r.word): r[name[2:].replace("interp_", "")] for r in m.scored(keys).collect()}
    got = {(r.w2, r.w1, r.word): r[3] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(x, abs=0.6 * 10**-places_kept) for k, x in want.items()}
    spent = shuffled(spark, lambda: catalogue.QUERIES[name](spark, SMALL).write.format("noop").mode("overwrite").save())
    assert spent < 6 * os.path.getsize(f"{SMALL}/documents.parquet")


def test_scores_of_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.QUERIES["q_norm_score"](spark, str(tmp_path)).count() == 0


def test_predictions(spark):
    m = ngram.NgramModel.build(sents(spark, [["a", "b", "c"], ["a", "b", "d"], ["a", "e", "d"]]))
    ctx = spark.createDataFrame([(1, None, "a"), (2, "a", "b"), (3, None, None)], "id long, w2 string, w1 string")
    got = {}
    for r in m.predict(ctx, 2).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.word)
    assert got == {1: ["b", "e"], 2: ["d", "c"], 3: ["a", "b"]}  # d follows b as often as c, and is more frequent


def test_predictions_are_in_the_order_of_scores(spark):
    """After x, the rare pair's word is scored below frequent words that have not followed it; after two words none is filled in."""
    m = ngram.NgramModel.build(sents(spark, [["x", "y"]] + [["z"] * 40, ["w"] * 30]))
    ctx = spark.createDataFrame([(1, None, "x"), (2, "z", "x")], "id long, w2 string, w1 string")
    rows = m.predict(ctx, 3).orderBy("id", "rank").collect()
    assert [r.word for r in rows if r.id == 2] == ["y"] and {r.word for r in rows if r.id == 1} <= {"y", "z", "w"}
    assert [r.score for r in rows if r.id == 1] == sorted((r.score for r in rows if r.id == 1), reverse=True)
    keys = spark.createDataFrame([(None, "x", r.word) for r in rows if r.id == 1], "w2 string, w1 string, word string")
    assert {r.word: r.score for r in m.scored(keys).collect()} == {r.word: r.score for r in rows if r.id == 1}


def test_predictions_with_a_prefix(spark):
    m = ngram.NgramModel.build(sents(spark, [["a", "ba"], ["a", "bb"], ["a", "bb"], ["c", "ba"]]))
    index = spark.createDataFrame([("바", "ba"), ("밥", "bb"), ("바나", "c")], "hangul string, surface string")
    ctx = spark.createDataFrame([(1, None, "a", "바"), (2, None, "a", ""), (3, None, "a", "x")], "id long, w2 string, w1 string, prefix string")
    got = [(r.id, r.surface, r.hangul) for r in m.predict_with_prefix(ctx, index, 2).orderBy("id", "rank").collect()]
    assert got == [(1, "ba", "바"), (1, "c", "바나"), (2, "bb", "밥"), (2, "ba", "바")]


SMALL = "/root/testdata/sf0.01"  # documents whose pieces are large enough to compress
WORDS = "words array<struct<surface:string,reading:string,hangul:string>>"


def test_predictions_with_a_prefix_are_those_of_all_entries(spark):
    """Against scores of all entries; what joins read stays far below contexts times entries."""
    rng = random.Random(3)
    names = [a + b + c for a in "pq" for b in "xyz" for c in "uvw"] + ["p", "px", "q"]
    m = ngram.NgramModel.build(sents(spark, [[rng.choice(names) for _ in range(12)] for _ in range(60)]))
    entries = [(n, n) for n in names] + [("pxu", "qzw"), ("pxu", "qzw"), ("pq", "unknown")]
    index = spark.createDataFrame(entries, "hangul string, surface string")
    rows = [(f"{i}", rng.choice([None, *names]), rng.choice([*names, "unknown"]), rng.choice(["", "p", "q", "px", "qz", "pxu", "z", None])) for i in range(80)] + [("none", None, None, "p")]
    ctx = spark.createDataFrame(rows, "id string, w2 string, w1 string, prefix string")
    keys = spark.createDataFrame([(i, w2, w1, h, s) for i, w2, w1, p in rows if p is not None for h, s in entries if h.startswith(p)], "id string, w2 string, w1 string, hangul string, word string")
    want = {}
    for r in sorted(m.scored(keys).collect(), key=lambda r: (-r.score, r.word, r.hangul)):
        want.setdefault(r.id, []).append((r.word, r.hangul, r.score))
    got = {}
    for r in m.predict_with_prefix(ctx, index, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.surface, r.hangul, r.score))
    assert got == {i: rows[:3] for i, rows in want.items()}


def test_prefix_predictions_pair_no_words_that_never_met(spark, tmp_path, monkeypatch):
    """1,000 words of one beginning make 1,000,000 pairs, of which a sentence has 999."""
    spark.createDataFrame([(0, " ".join(f"pre{i}" for i in range(1000)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked, counted = [], ngram.NgramModel.counted
    monkeypatch.setattr(ngram.NgramModel, "counted", lambda m, keys: asked.append(keys.count()) or counted(m, keys))
    out = catalogue.QUERIES["q_predict_prefix"](spark, str(tmp_path))
    assert out.count() == 2000 and out.where("id = 'pre7' and rank = 1").first().surface == "pre8"
    assert sum(asked) == 999


def test_cooccurrence(spark):
    df = spark.createDataFrame([(1, 0, [("桜", "さくら", "x"), ("花", "はな", "y")])], f"chunk long, sid long, {WORDS}")
    got = {(r.a, r.b): r.x for r in cooccurrence.matrix(df).collect()}
    assert got["桜", "花"] == got["花", "桜"] == 1.0 and got["桜", "はな"] == 0.5 and got["桜", "さくら"] == 2.0
    assert {(r.a, r.b) for r in cooccurrence.trainable(cooccurrence.matrix(df)).collect()} == {tuple(sorted(p)) for p in got}
    f, b = cooccurrence.directional(df, compat=False)
    assert f.where("a = '桜' and b = '花'").count() == 1 and b.where("a = '桜' and b = '花'").count() == 0


def test_neighbours(spark):
    df = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["b", "c"]), (2, 2, ["d"])], "chunk long, sid long, words array<string>")
    got = {(r.u, r.v): r.x for r in cooccurrence.neighbour_pairs(df, 1).collect()}
    assert got == {("a", "b"): pytest.approx(1 / 2), ("a", "c"): pytest.approx(1 / 3)}


@pytest.fixture(scope="module")
def world(spark):
    entries = spark.createDataFrame([("とうきょう", "東京", 5000), ("とうきょうたわー", "東京タワー", 3000), ("どうろ", "道路", 2000)], "reading string, surface string, frequency long")
    pairs = spark.createDataFrame([("도쿄", "とうきょう"), ("도쿄타워", "とうきょうたわー"), ("도로", "どうろ")], "hangul string, reading string")
    m = ngram.NgramModel.build(sents(spark, [["東京", "東京タワー"], ["東京", "道路"], ["東京", "道路"]]))
    vectors = spark.createDataFrame([], "word string, vector array<float>")
    return autocomplete.surface_index(pairs, entries), entries, m, vectors


def test_strict_prefix(spark, world):
    q = spark.createDataFrame([(1, "도쿄", [])], "id long, partial string, words array<string>")
    got = autocomplete.completions(world[0], q).collect()
    assert [(r.surface, r.saving) for r in got if r.frequency > 0] == [("東京タワー", 2)]


def test_suggestions_and_typing(spark, world):
    q = spark.createDataFrame([(1, "도", []), (2, "", ["東京"])], "id long, partial string, words array<string>")
    got = autocomplete.suggestions(q, *world).where("rank = 1").collect()
    assert {(r.id, r.surface, r.tier) for r in got} == {(1, "東京", "PrefixCompletion"), (2, "道路", "NextWord")}
    s = spark.createDataFrame([(1, [("東京", "도쿄"), ("道路", "도로")])], "sid long, words array<struct<surface:string,hangul:string>>")
    rows = {r.wid: r for r in autocomplete.simulated(s, 1, *world).collect()}
    assert (rows["1/0"].plain, rows["1/0"].used) == (3, 2) and (rows["1/1"].used, rows["1/1"].next_hit) == (1, 1)
    total = evaluation.keystrokes(autocomplete.simulated(s, 1, *world)).first()
    assert total.plain == 6 and total.used == 3 and total.saving == 0.5


def test_typing_asks_once_for_what_suggestions_see(spark, world, monkeypatch):
    """Only the last two words and words with vectors count, where they stand; sums are those of all words."""
    vectors = spark.createDataFrame([("道路", [1.0, 0.5]), ("東京タワー", [0.2, 1.0])], "word string, vector array<float>")
    names = [("東京", "도쿄"), ("東京タワー", "도쿄타워"), ("道路", "도로"), ("x", "도"), (None, "도쿄")]
    rng = random.Random(5)
    rows = [(i, [rng.choice(names) for _ in range(6)]) for i in range(30)] + [(30, [("y", f"{k}") for k in range(9)])]
    s = spark.createDataFrame(rows, "sid long, words array<struct<surface:string,hangul:string>>")
    plain = autocomplete.typed_words(s).select("wid", "words", F.explode(F.sequence(F.lit(0), F.length("hangul"))).alias("i"), "hangul", "surface").where("i > 0 or size(words) > 0")
    every = plain.select(F.concat_ws("/", "wid", "i").alias("id"), F.expr("substring(hangul, 1, i)").alias("partial"), "words")
    top = {r.id: (r.surface, r.saving) for r in autocomplete.suggestions(every, *world[:3], vectors).where("rank = 1").collect()}
    want = {}
    for r in plain.collect():
        n, (surface, saving) = len(r.hangul), top.get(f"{r.wid}/{r.i}", (None, 0))
        at = want.setdefault(r.wid, [n + 1, set()])
        if surface is not None and surface == r.surface and (r.i == 0 or saving >= 1 and r.i < n):
            at[1].add(r.i)
    want = {w: (n, (1 if min(hits) == 0 else min(hits) + 1) if hits else n) for w, (n, hits) in want.items()}
    asked, suggestions = [], autocomplete.suggestions
    monkeypatch.setattr(autocomplete, "suggestions", lambda q, *more: asked.append(q.count()) or suggestions(q, *more))
    got = autocomplete.simulated(s, 1, *world[:3], vectors).collect()
    assert {r.wid: (r.plain, r.used) for r in got} == want
    total = autocomplete.totals(s, 1, *world[:3], vectors).first()
    assert (total.words, total.plain, total.used, total.next_hits, total.prefix_hits) == (len(got), *(sum(r[c] for r in got) for c in ("plain", "used", "next_hit", "prefix_hits")))
    autocomplete.totals(spark.createDataFrame([(i, [("z", "도")] * (3 + i)) for i in range(9)], s.schema), 1, *world[:3], vectors).first()
    assert asked[-1] == 5  # nothing, one or two words before; with words before, the empty partial too



def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (2, None, "b")], "sid long, rank int, category string")
    r = evaluation.accuracy(df).first()
    assert (r.words, r.top1, r.top3, r.sentences) == (4, 0.5, 0.75, 0.0)
    assert [(x.category, x.exact) for x in evaluation.by_category(df).collect()] == [("a", 1), ("b", 1)]
    assert evaluation.keystrokes(spark.createDataFrame([], "plain long, used long")).select(F.coalesce("saving", F.lit(0.0)).alias("s")).first().s == 0
    long = spark.createDataFrame([("せんせい",), (None,)], "reading string")
    assert [(r.pattern, r.n) for r in evaluation.long_vowel_patterns(long).collect()] == [("せい", 1)]


def test_reports(spark):
    rows = spark.createDataFrame([("せんせい", 1, None), ("かぜ", 1, 1), ("はな", 2, 1)], "reading string, plain int, marked int")
    got = {r.long: (r.words, r.plain, r.marked) for r in evaluation.by_long_vowels(rows, ["plain", "marked"]).collect()}
    assert got == {True: (1, 1.0, 0.0), False: (2, 0.5, 1.0)}
    cands = spark.createDataFrame([("a", [("a", 0.9)]), ("b", [("x", 0.9), ("b", 0.1)]), ("c", []), ("d", None)], "reading string, candidates array<struct<hira:string,conf:double>>")
    r = evaluation.decoded(cands).first()
    assert (r.words, r["any"], r["first"]) == (4, 0.5, 0.25)
    words = spark.createDataFrame([(1, 0, "花", "하나", "花"), (2, 1, "見る", "미루", None), (2, 0, "桜", "사쿠라", "桜"), (3, 0, "風", "카제", "風邪")], "sid long, pos int, surface string, hangul string, restored string")
    assert [tuple(r) for r in evaluation.failing(words).collect()] == [(2, "桜見る", "사쿠라 미루", "桜"), (3, "風", "카제", "風邪")] and evaluation.failing(words, 1).count() == 1
    cats = spark.createDataFrame([("b",), ("a",), ("b",)], "category string")
    assert [tuple(r) for r in readers.category_stats(cats).collect()] == [("b", 2), ("a", 1)]


VOCAB = [("犬", "いぬ", "Noun", "Animal"), ("食べる", "たべる", "Verb", "Action"), ("赤い", "あかい", "IAdjective", "Color"), ("とても", "とても", "Adverb", "Other"), ("朝", "あさ", "Noun", "Time"), ("駅", "えき", "Noun", "Place")]


def vocab(spark):
    return spark.createDataFrame([(*v, i) for i, v in enumerate(VOCAB)], "surface string, reading string, pos string, category string, load_seq long")


def test_generator(spark):
    d = generator.Draws(42)
    assert d.below(1 << 63) == (42 * generator.MULTIPLIER + generator.INCREMENT) % (1 << 64) % (1 << 63)
    a, b = (generator.exact(vocab(spark), 30).orderBy("sid").collect() for _ in range(2))
    assert a == b and len(a) == 30 and len({r.category for r in a}) > 1
    name = generator.register(spark, vocab(spark))
    c = spark.read.format(name).option("count", 30).load().orderBy("sid").collect()
    assert [r.words for r in c] == [r.words for r in a]
    assert generator.scaled(vocab(spark), 50).count() == 50
    none = generator.exact(vocab(spark).where("pos = 'x'"), 5)
    assert none.count() == 0


def test_scaled_over_a_large_vocabulary(spark):
    rows, count = 200_010, 40
    pos, category = ("Noun", "Verb", "IAdjective", "Adverb"), ("Time", "Place", "Food", "Other", None)
    at = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % len(names) + 1).cast("int"))
    v = spark.range(rows).select(F.concat(F.lit("s"), "id").alias("surface"), F.concat(F.lit("r"), "id").alias("reading"), at(pos).alias("pos"), at(category).alias("category"), (rows - F.col("id")).alias("load_seq"))
    known = generator.Grammar([(f"s{i}", f"r{i}", pos[i % 4], category[i % 5]) for i in reversed(range(rows))])
    seeds = spark.range(count).select("id", F.xxhash64(F.lit(generator.SEED), "id").alias("h")).collect()
    want = {r.id: known.sentence(generator.Draws(r.h)) for r in seeds}
    got = {r.sid: (r.category, [w.asDict() for w in r.words]) for r in generator.scaled(v, count).collect()}
    assert got == want


def test_sentence_files(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    good = '{"words": [{"surface": "a", "reading": "b", "hangul": "c"}, {"surface": "d", "reading": "e", "hangul": "f"}]}'
    lacking = '{"category": "x", "words": [{"surface": "a", "reading": "b", "hangul": "c"}, {"surface": "d"}]}'
    path.write_text("\n".join([good, "not json", lacking, good.replace('{"words"', '{"category": "news", "words"')]))
    got = readers.sentences(spark, str(path)).collect()
    assert [(r.category, len(r.words)) for r in got] == [("wikipedia", 2), ("news", 2)]
    assert readers.sentences(spark, str(path), 1).count() == 1
    s = readers.sentences(spark, str(path))
    assert readers.unique_words(s).count() == 2 and readers.corpus_stats(s).first().tokens == 4
    assert readers.surfaces(s).first().surfaces == ["a", "d"]


def test_vocabulary_files_and_tables(spark, tmp_path):
    for tier, rows in (("core", VOCAB[:3]), ("N5", VOCAB[3:])):
        (tmp_path / f"{tier}.csv").write_text("surface,reading,pos,category\n" + "\n".join(",".join(r) for r in rows))
    t = readers.tiers(spark, {k: str(tmp_path / f"{k}.csv") for k in ("core", "N5")})
    assert t.count() == 6 and t.where("tier = 'N5'").first().frequency == 500
    assert readers.by_class(t, "Noun", "Time").first().surface == "朝"
    assert {r.pos: r.n for r in readers.class_counts(t).collect()}["Noun"] == 3
    assert readers.with_hangul(t.where("surface = '犬'")).first().hangul == "이누"
    v = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1)], "word string, vector array<float>, dim int")
    readers.write_table(v, str(tmp_path / "v"))
    readers.upsert(spark, str(tmp_path / "v"), spark.createDataFrame([("a", [3.0], 1)], v.schema), ["word"], str(tmp_path / "w"))
    assert {r.word: r.vector for r in readers.embeddings(spark, str(tmp_path / "w")).collect()} == {"a": [3.0], "b": [2.0]}
    log = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, seq long")
    assert [tuple(r) for r in readers.meta(log).collect()] == [("k", "2")]


def test_clicks(spark):
    rows = [("POST", '{"platform": "macos"}', "u" * 400, "r"), ("POST", '{"platform": "toaster"}', None, None), ("GET", "{}", "u", "r"), ("POST", "not json", "u", "r")]
    got = readers.clicks(spark.createDataFrame(rows, "method string, body string, user_agent string, referrer string").withColumn("at", F.current_timestamp())).collect()
    assert [r.platform for r in got] == ["macos", "unknown", "unknown"] and len(got[0].user_agent) == 300
