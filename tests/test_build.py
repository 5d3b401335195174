from pyspark.sql import functions as F

from moraline.functions import kana
from moraline.operators import ngram
from moraline.plans import build

WORDS = "words array<struct<surface:string,reading:string,hangul:string>>"


def sentences(spark):
    w = lambda s, r: (s, r, kana.to_hangul(r))
    rows = [[w("桜", "さくら"), w("花", "はな"), w("見る", "みる")], [w("風邪", "かぜ"), w("鼻", "はな")], [w("桜", "さくら"), w("花", "はな")]]
    return spark.createDataFrame([(i // 2, i, r) for i, r in enumerate(rows)], f"chunk long, sid long, {WORDS}")


def test_models_and_conversion(spark, tmp_path):
    extras = spark.createDataFrame([("はな", "華", 70), ("はな", "花", 9)], "reading string, surface string, frequency int")
    size = build.build(sentences(spark), str(tmp_path), build.Config(dim=8, rounds=5, scale=100, reach=1, longest=2), extras)
    assert size["sentences"] == 3 and size["entries"] == 6 and size["vectors"] > 5
    e = {(r.reading, r.surface): r.frequency for r in spark.read.parquet(str(tmp_path / "entries")).collect()}
    assert e["さくら", "桜"] == 200 and e["はな", "花"] == 9 and e["はな", "華"] == 70
    assert ngram.NgramModel.load(spark, str(tmp_path / "ngrams")).total == 10
    c = build.Converter.load(spark, str(tmp_path))
    got = c.convert(spark.createDataFrame([(1, "사쿠라")], "id long, hangul string")).orderBy("rank").collect()
    assert got[0].hira == "さくら" and {"桜", "さくら"} <= {r.surface for r in got} and len(got) <= 9
    assert c.hiragana(spark.createDataFrame([("사쿠라 미루",)], "hangul string")).first().decoded == "さくら みる"


def test_directional_vectors_and_vocabulary(spark):
    v = {r.word for r in build.embeddings(sentences(spark), build.Config(dim=4, rounds=2, directional=True)).collect()}
    assert {"F:桜", "B:桜", "桜"} <= v
    words = spark.createDataFrame([("公園", "こうえん", 1000, 0), ("講演", "こうえん", 500, 1), ("公園", "こうえん", 300, 2)], "surface string, reading string, frequency long, load_seq long")
    c = build.Converter.of_vocabulary(words.withColumn("hangul", kana.hangul("reading")))
    assert c.map_size() == 3
    first = c.convert(spark.createDataFrame([(1, "코우에ㄴ")], "id long, hangul string")).count()
    assert first > 0
    assert c.entries.where(F.col("surface") == "公園").first().frequency == 300


def test_command_line(spark, tmp_path, capsys):
    import io
    import json

    from moraline import __main__ as cli

    out = io.StringIO()
    assert cli.main(["사쿠라"], out=out) == 0 and "さくら" in out.getvalue()
    assert cli.main([], out=out) == 0 and "usage" in out.getvalue()
    path = tmp_path / "s.jsonl"
    words = [{"surface": s, "reading": r, "hangul": kana.to_hangul(r)} for s, r in (("桜", "さくら"), ("花", "はな"))]
    path.write_text("\n".join(json.dumps({"words": words}) for _ in range(3)))
    out = io.StringIO()
    assert cli.main(["build", str(path), str(tmp_path / "m"), "--dim", "4", "--rounds", "2"], out=out) == 0 and "sentences: 3" in out.getvalue()
    out = io.StringIO()
    cli.main(["--models", str(tmp_path / "m"), "--interactive"], lines=["사쿠라", "", "quit", "하나"], out=out)
    assert "桜" in out.getvalue() and "花" not in out.getvalue()
    (tmp_path / "v.csv").write_text("surface,reading,pos,category\n犬,いぬ,Noun,Animal\n食べる,たべる,Verb,Action\n赤い,あかい,IAdjective,Color\n朝,あさ,Noun,Time\n駅,えき,Noun,Place\n")
    out = io.StringIO()
    assert cli.main(["generate", str(tmp_path / "v.csv"), str(tmp_path / "g"), "--count", "20", "--dim", "4", "--rounds", "2"], out=out) == 0 and "sentences: 20" in out.getvalue()
