"""Fingerprints, repeats, similarity joins and token ids against brute force."""

import collections
import hashlib
import re
import types

import numpy as np
import pyarrow as pa
import pytest

from moraline.llm import _text as tx
from moraline.llm import bpe, fingerprint, mixing, repeats, setjoin, tokenfiles
from tests.conftest import SMALL

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fold(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def test_words():
    col = pa.array(["Aa b", None, "", " x\ty ", "aa"])
    data, offs = tx.flat(col)
    starts, ends, h, first = tx.words(data, offs)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"Aa", b"b", b"x", b"y", b"aa"]
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and h[0] == h[4] and len(set(h.tolist())) == 4
    assert [p.num_rows for p in tx.pieces(pa.record_batch({"text": ["a" * 10] * 5}), most=25)] == [2, 2, 1]
    c = tx.Counts(10)
    for _ in range(3):
        c.add(np.array([5, 1, 5], np.uint64))
    k, n = c.flush()
    assert dict(zip(k.tolist(), n.tolist())) == {1: 3, 5: 6}


def test_fingerprints(spark, nasty, texts, nothing):
    got = fingerprint.neighbour_report(nasty).collect()
    assert len(got) == len(texts)
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = collections.Counter()
    for (i, a), (_, b) in zip(order, [*order[1:], order[0]]):
        e = fingerprint.edited(a or "", b or "")
        want[i, len(a or ""), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[2].fingerprint != by[1].fingerprint and by[3].fingerprint == by[4].fingerprint == by[5].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    a, b = (fingerprint.Prints.from_text([by[i].fingerprint]) for i in (0, 1))
    assert a.as_text() == [by[0].fingerprint] and a.likeness(a)[0] == 1 and a.likeness(b)[0] > 0.7
    assert fingerprint.neighbour_report(nothing).count() == 0
    assert fingerprint.neighbour_report(nasty.limit(1)).count() == 1


@pytest.mark.parametrize("buckets", [2, 8, 40])
def test_successors_of_repeated_and_missing_ids(spark, monkeypatch, buckets):
    """A third of the rows have one id and a third none: each row has one successor, in the order of ids, and no slot gathers an id."""
    monkeypatch.setattr(fingerprint, "partitions", lambda _: buckets)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"{i:04d}" * 5) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.neighbour_report(docs).collect()
    shas = {hashlib.sha256(fingerprint.edited(a, b).encode()).hexdigest(): (j, k) for j, (_, a) in enumerate(rows) for k, (_, b) in enumerate(rows)}
    after = dict(shas[r.edited_sha256] for r in got)
    assert len(got) == 300 and sorted(after) == sorted(after.values()) == list(range(300))
    key = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    assert sum(key(b) < key(a) for a, b in after.items()) == 1
    ranged, _ = fingerprint.in_order(docs)
    assert max(r["count"] for r in ranged.groupBy("slot").count().collect()) <= 3 * 300 / buckets + 5


def plain_prints(lexicon, model, text):
    """The cells of a text's fingerprint, one subset after the other: the hash of the sorted distinct terms that it holds."""
    words = {tx.word_hash(w.decode()) for w in WORD.findall(fold(text))}
    rest = sorted(words - lexicon, key=lambda w: int(tx.mix(np.array([w], np.uint64))[0]))
    terms = sorted(words & lexicon | set(rest[: max(0, fingerprint.FEW - len(words & lexicon))]))
    mod = 1 << 64

    def of(held):
        h = 0
        for t in held:
            h = (h * int(fingerprint._STEP) + int(tx.mix(np.array([t], np.uint64))[0])) % mod
        return int(tx.mix(np.array([(h + len(held)) % mod], np.uint64))[0]) | 1 if held else 0

    cells = np.zeros((model.levels, model.subsets), int)
    for k, salt in enumerate(model.salt.tolist()):
        drawn = {}
        for t in terms:
            x = (t ^ t >> 29) * salt % mod
            drawn[t] = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % mod
        for level in range(model.levels):
            h = of([t for t in terms if drawn[t] < 1 << 63 - level])
            cells[level, k] = (h >> 40 & 0xFFFF) | 1 if h else 0
    return of(terms), cells


def plain_likeness(a, b):
    if a[0] == b[0] and (a[1] == b[1]).all():
        return 1.0
    pairs = [[(x, y) for x, y in zip(r, s) if x or y] for r, s in zip(a[1].tolist(), b[1].tolist())]
    dense = [i for i, p in enumerate(pairs) if 2 * len(p) >= a[1].shape[1]]
    level = dense[-1] if dense else 0
    used = [p for row in pairs[level : level + 2] for p in row]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def test_fingerprints_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    df = collections.Counter(w for _, t in rows for w in set(WORD.findall(fold(t))))
    lexicon = {tx.word_hash(w.decode()) for w, n in df.items() if fingerprint.LOW * len(rows) <= n <= fingerprint.HIGH * len(rows)}
    assert set(fingerprint.lexicon(docs).tolist()) == lexicon
    model = fingerprint.Fingerprinter(np.array(sorted(lexicon), np.uint64))
    got = {r.doc_id: r for r in fingerprint.neighbour_report(docs).collect()}
    near = [0, 0]
    for (i, a), (_, b) in list(zip(rows, [*rows[1:], rows[0]]))[::7]:
        own, new, after = (plain_prints(lexicon, model, t) for t in (a, fingerprint.edited(a, b), b))
        assert got[i].fingerprint == fingerprint.Prints(np.array([own[0]], np.uint64), own[1][None].astype(np.uint16)).as_text()[0]
        assert got[i].near_edited == pytest.approx(plain_likeness(own, new)) and got[i].near_next == pytest.approx(plain_likeness(own, after))
        near = [near[0] + got[i].near_edited, near[1] + got[i].near_next]
    assert near[0] > 5 * near[1]


def test_frequent_items(spark):
    from moraline.llm._spark import frequent

    df = spark.createDataFrame([(f"a b w{i}",) for i in range(50)] + [("c",)], "text string").repartition(7)
    keys, n, total = frequent(df, fingerprint._distinct_words, 0.5)
    assert total == 51 and sorted(n.tolist()) == [50, 50] and set(keys.tolist()) == {tx.word_hash("a"), tx.word_hash("b")}


def test_lexicon_of_a_band(spark):
    docs = spark.createDataFrame([(i, f"all w{i % 4} own{i}") for i in range(40)], "doc_id long, text string")
    assert set(fingerprint.lexicon(docs, 0.1, 0.5).tolist()) == {tx.word_hash(f"w{k}") for k in range(4)}


def covered(rows, length):
    where = collections.defaultdict(list)
    for k, b in enumerate(rows):
        for s in range(len(b) - length + 1):
            where[b[s : s + length]].append((k, s))
    gone = [np.zeros(len(b), bool) for b in rows]
    for places in where.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s : s + length] = True
    return gone


@pytest.mark.parametrize("length", [24, 200])
def test_repeats(spark, nasty, texts, length):
    rows = [(t or "").encode() for _, t in texts]
    want = collections.Counter()
    for (i, _), b, g in zip(texts, rows, covered(rows, length)):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        want[i, len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.removal_report(nasty, length).collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_texts_with_null_ids_stay_apart(spark):
    """Two texts without ids whose 24-bit hashes are equal; only one of them occurs again."""
    from pyspark.sql import functions as F

    text = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(x)), 256) for x in "abcde"))
    some = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    first, second = some.groupBy(F.hash("text", F.lit(True)).bitwiseAND(0xFFFFFF)).agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) > 1").first().t[:2]
    docs = spark.createDataFrame([(None, first), (None, second), (5, first)], "doc_id long, text string")
    got = {(r.doc_id, r.kept_sha256): r.n_removed for r in repeats.removal_report(docs).collect()}
    kept = hashlib.sha256(second.encode()).hexdigest()
    assert got[None, kept] == 0 and sorted(got.values()) == [0, len(first), len(first)]


def test_suffix_arrays_of_a_family():
    """Levels hold suffixes in the order of their bytes, with common prefixes, and know which occur again as a whole."""
    rng = np.random.default_rng(6)
    family, kept, told = repeats.Family(), [], 0
    for _ in range(21):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[rng.integers(0, 400, 3)] = 0
        start = np.arange(0, 380, 3)
        size = rng.integers(4, 20, len(start))
        own = [bytes(data[a : a + n]) for a, n in zip(start, size)]
        code = np.array([hash(x) & (2**62 - 1) for x in own], np.uint64)
        again = family.add(data, start, size, code, code, np.array([len(kept) + i for i in range(len(own))]))
        told += len(again)
        kept += own
        for level in family.levels:
            read = [bytes(level.data[a : a + n]) for a, n in zip(level.start, level.size)]
            assert [x.ljust(24, b"\0") for x in read] == sorted(x.ljust(24, b"\0") for x in read)
            common = [next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y))) for x, y in zip(read, read[1:])]
            assert level.common[1:].tolist() == common
    sizes = [len(x) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(family) + told == len(kept)
    n = collections.Counter(kept)
    again, _, _, which = family.take()
    assert all(a for a, i in zip(again, which) if n[kept[i]] > 1) and len(family) == 0
    assert all(sum(x.startswith(kept[i]) for x in kept) > 1 for a, i in zip(again, which) if a)


def test_repeats_of_short_texts(spark):
    docs = spark.createDataFrame([(1, "short text"), (2, "short text"), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in repeats.removal_report(docs).collect()} == {(i, 0) for i in (1, 2, 3, 4)}
    assert repeats.without_repeats(docs.limit(1)).collect()[0].kept_text == "short text"


def test_repeats_of_many_rows_without_ids(spark):
    """50,000 texts with a null or a repeated id, of which a few occur twice."""
    from pyspark.sql import functions as F

    text = F.concat(*(F.sha2(F.concat((F.col("id") % 49_990).cast("string"), F.lit(x)), 256) for x in "abcd"))
    docs = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), text.alias("text"))
    got = repeats.removal_report(docs).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: 49_980, 256: 20}


def test_repeats_of_nothing(nothing):
    assert repeats.removal_report(nothing).count() == 0
    assert repeats.without_repeats(nothing, "lang").columns == ["doc_id", "lang", "kept_text", "n_removed"]


def test_anchors_in_fragments(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offs = np.array([0, 100, 3100, 3100, 5000])

    def windows(limit):
        monkeypatch.setattr(repeats, "_PLACE", np.uint64(limit))
        row, _, _, lo, hi, at = repeats.anchors(data, offs, 40)
        return sorted((int(r), int(s), int(a)) for r, x, y, a in zip(row, lo, hi, at) for s in range(x, y + 1))

    # the places of a window's anchor don't depend on where fragments are cut
    assert windows((1 << 21) - 1) == windows((1 << 10) - 1 + 0) or len(windows(1023)) == sum(n - 39 for n in (100, 3000, 1900))


def sets(rows):
    out = []
    for _, t in rows:
        w = WORD.findall(fold(t))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows):
    s = sets(rows)
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                label[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return [(i, len(s[k]), min((x for x in ids[root(k)] if x is not None), default=i) if s[k] else i) for k, (i, _) in enumerate(rows)]


def test_similarity_join(spark, nasty, texts, nothing):
    got = setjoin.near_duplicates(nasty).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == collections.Counter(brute_components(texts))
    kept = setjoin.keep_one(nasty)
    assert kept.columns == nasty.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2})
    assert setjoin.near_duplicates(nothing).count() == 0 and setjoin.keep_one(nothing).count() == 0


def test_family_of_near_copies(spark):
    """Copies at every distance from an original, so that many pairs are close to the limit on either side."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.choice(150, i // 5, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for n in (3, 90, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.r_[x[: n * 19 // 20], rng.integers(0, 1 << 62, n // 20).astype(np.uint64)])
        apart = len(np.setxor1d(x, y))
        s = min(setjoin.buckets(len(x)), setjoin.buckets(len(y)))
        h = [setjoin.folded(setjoin.histogram(v), s).astype(int) for v in (x, y)]
        assert np.abs(h[0] - h[1]).sum() <= apart
        if len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            signer = setjoin.Signer(np.zeros(0, np.uint64))
            assert np.intersect1d(signer.of(x), signer.of(y)).size


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in setjoin.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_token_ids(spark, nasty, texts, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    odd = ["<|endoftext|>a <|endoftext|>", "it's I'LL  \n\n\t x　\x1c\x1d y\x85z\xa0 ​ 12½Ⅷ٣ 東京 é", "aaaaaaa", "   ", "a   b "]
    rows = [t or "" for _, t in texts] + odd
    model = bpe.Bpe()
    for t, (ids, back) in zip(rows, model.encode_rows(rows), strict=True):
        e = lib.encode(t, add_special_tokens=False)
        assert ids == ",".join(map(str, e.ids)) and back.decode("utf-8", "replace") == lib.decode(e.ids, skip_special_tokens=False)
    assert model.decode(model.encode("héllo")) == "héllo" and model.encode("") == []
    got = collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(nasty).collect())
    want = collections.Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert got == want
    assert collections.Counter((r.doc_id, len(r.ids)) for r in bpe.encoded(nasty).collect()) == collections.Counter((i, n) for i, n, _ in want.elements())
    assert bpe.digests(nothing).count() == 0


def test_bpe_worker_keeps_no_words(spark, monkeypatch):
    """Idle workers take turns, so each would hold the words of its last task beside the two that run."""
    model = bpe.Bpe()
    monkeypatch.setattr(bpe, "share", lambda *_: types.SimpleNamespace(value=model))
    docs = types.SimpleNamespace(sparkSession=spark, select=lambda *_: types.SimpleNamespace(mapInArrow=lambda run, _: run))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "of two texts"]})
    out = bpe.encoded(docs)(iter([batch, batch]))
    assert next(out).num_rows == 2 and model.cache
    assert sum(b.num_rows for b in out) == 2 and not model.cache


def test_token_files(spark, nasty, texts, nothing, tmp_path):
    coder = tokenfiles.tokenizer()
    got = tokenfiles.document_counts(nasty).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(coder.encode_ordinary(t or ""))) for i, t in texts)
    assert tokenfiles.document_counts(nothing).count() == 0
    flat = {"a": [1, 2, 9, 9, 3, 3, 3, 3, 3, 9, 4], "b": [], "c": [9], "d": [5] * 40}
    for name, ids in flat.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in flat], "file string")
    for size in (1, 3, 7, 100):
        rows = tokenfiles.counts(spark, files, eod=9, block_ids=size).collect()
        assert sorted((r.file[-1], r.ordinal, r.start, r.n_tokens) for r in rows) == [("a", 0, 0, 2), ("a", 1, 3, 0), ("a", 2, 4, 5), ("a", 3, 10, 1), ("c", 0, 0, 0), ("d", 0, 0, 40)]


def test_flat_files_go(spark, nasty):
    import os

    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    tokenfiles.document_counts(nasty).collect()
    assert not [f for d, _, names in os.walk(re.sub("^file:", "", root)) for f in names if f.endswith(".bin")]


def test_mixing_with_many_sources_and_clashing_names(spark, nasty, monkeypatch):
    few = mixing.mixed(nasty).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(str, mixing.mixed(nasty).collect())) == sorted(map(str, few))
    clash = nasty.withColumnRenamed("label", "copy").withColumnRenamed("key", "shuffle_key").withColumnRenamed("word", "rate")
    got = mixing.mixed(clash)
    assert got.columns == [*clash.columns, "copy_", "shuffle_key_"] and {r["copy"] for r in got.collect()} == {"x"} and got.count() == len(few)


def test_mixing(spark, nasty, nothing):
    import duckdb

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(mixing.oracle()).fetchall()
    got = mixing.mixed(docs).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key").collect()
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == sorted(map(tuple, want), key=lambda r: r[-1])
    ranks = spark.range(20_000).select(mixing.poisson(mixing.F.lit(2.5), mixing.uniform(mixing.F.col("id").cast("string"))).alias("k")).toPandas().k
    assert abs(ranks.mean() - 2.5) < 0.05 and abs(ranks.var() - 2.5) < 0.15
    many = mixing.mixed(docs, {"src0": 1.0})
    assert {r.source for r in many.select("source").distinct().collect()} == {"src0"}
    total, own = (docs.agg({"n_chars": "sum"}).first()[0], many.agg({"n_chars": "sum"}).first()[0])
    assert 0.7 < own / total < 1.3
    assert set(mixing.mixed(nasty).columns) == {*nasty.columns, "copy", "shuffle_key"} and mixing.mixed(nothing).count() == 0


def test_waiting_workers_keep_no_powers():
    from moraline.llm import _text as tx

    assert len(tx.powers(10)) == 10
    assert not list(tx.trimmed(lambda batches: batches)(iter([])))
    assert not tx._powers


def test_tables_are_read_in_small_batches_while_one_is_written(spark, monkeypatch):
    from moraline.sources import scratch

    key, df, seen = "spark.sql.parquet.columnarReaderBatchSize", spark.range(5), []
    kind, before = type(df.write), spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    plain = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, path: (seen.append(int(spark.conf.get(key))), plain(self, path)))
    assert scratch.written(df).count() == 5
    assert seen[0] <= 64 and spark.conf.get(key) == before
