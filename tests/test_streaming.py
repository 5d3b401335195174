from pyspark.sql import functions as F

from moraline.streaming import sessions


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_composing(spark, tmp_path):
    keys = [("s", i, k) for i, k in enumerate(["ㅎ", "ㅏ", "ㄴ", "BACKSPACE", "ENTER", "ㄱ"])] + [("t", 0, "ㅏ"), ("t", 1, "ESCAPE")]
    spark.createDataFrame(keys, "session string, seq long, letter string").coalesce(1).write.parquet(str(tmp_path / "k"))
    stream = spark.readStream.schema("session string, seq long, letter string").parquet(str(tmp_path / "k"))
    got = {(r.session, r.seq): (r.text, r.committed) for r in run(spark, sessions.composing(stream), "composing")}
    assert got["s", 2] == ("한", None) and got["s", 3] == ("하", None) and got["s", 4] == ("", "하") and got["s", 5] == ("ㄱ", None)
    assert got["t", 1] == ("", None)


def test_contexts_and_selections(spark, tmp_path):
    rows = [("s", i, f"w{i}") for i in range(25)]
    spark.createDataFrame(rows, "session string, seq long, word string").coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("session string, seq long, word string").parquet(str(tmp_path / "w"))
    got = {r.seq: r.words for r in run(spark, sessions.contexts(stream), "contexts")}
    assert got[0] == [] and got[24] == [f"w{i}" for i in range(4, 24)]
    log = stream.select(F.col("session").alias("input"), F.lit("x").alias("selected"), F.current_timestamp().alias("at"))
    got = run(spark, sessions.selection_counts(log), "selections", "complete")
    assert [(r.input, r["count"]) for r in got] == [("s", 25)]


def test_sentence_buffers(spark, tmp_path):
    """World B of the sentence tests as a stream of events."""
    schema = "session string, seq long, action string, hangul string, options array<struct<surface:string,reading:string,conf:double,frequency:long,vector:array<float>>>, segment int, candidate int"
    flower = [("花", "はな", 0.9, 8000, [0.85, 0.15, 0.05, 0.0]), ("鼻", "はな", 0.9, 5000, [0.05, 0.0, 0.85, 0.15]), ("はな", "はな", 0.9, 0, None)]
    wind = [("風", "かぜ", 0.9, 6000, [0.7, 0.3, 0.0, 0.0]), ("風邪", "かぜ", 0.9, 5000, [0.0, 0.05, 0.8, 0.2]), ("かぜ", "かぜ", 0.9, 0, None)]
    events = [("s", 0, "add", "하나", flower, None, None), ("s", 1, "add", "카제", wind, None, None), ("s", 2, "pop", None, None, None, None), ("s", 3, "commit", None, None, None, None)]
    events += [("t", 0, "add", "하나", flower, None, None), ("t", 1, "select", None, None, 0, 1), ("t", 2, "clear", None, None, None, None), ("t", 3, "commit", None, None, None, None)]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    got = {(r.session, r.seq): (r.text, r.committed) for r in run(spark, sessions.sentences(stream), "sentences")}
    assert got["s", 0] == ("花", None) and got["s", 1] == ("鼻風邪", None) and got["s", 2] == ("花", None) and got["s", 3] == ("", "花")
    assert got["t", 1][0] in ("鼻", "はな") and got["t", 2] == ("", None) and got["t", 3] == ("", "")


def test_buffers_survive_their_state():
    from moraline.operators.sentence import Segment, SentenceBuffer

    b = SentenceBuffer({"花": sessions.np.array([1, 0], "f4")}, ["x"])
    b.add(Segment("하나", [("花", "はな", 0.9, 5), ("はな", "はな", 0.9, 0)]))
    again = sessions._revived(sessions._kept(b))
    assert again.composed() == b.composed() and again.committed == ["x"] and again.segments == b.segments
    again.clear()
    assert again.composed() == "" and again.committed == ["x"]


def test_clicks_as_a_stream(spark, tmp_path):
    schema = "method string, body string, user_agent string, referrer string, at timestamp"
    spark.createDataFrame([("POST", '{"platform": "web"}', "u", "r"), ("GET", "{}", "u", "r")], "method string, body string, user_agent string, referrer string").withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(str(tmp_path / "c"))
    got = run(spark, sessions.clicks(spark.readStream.schema(schema).parquet(str(tmp_path / "c"))), "clicked")
    assert [r.platform for r in got] == ["web"]
