"""Classifiers by held-out accuracy, language model and nearest neighbours against brute force, the pipeline stage by stage."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraline.llm import backoff, neighbours, quality, toxicity
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()) if len(pos) and len(neg) else 1.0


@pytest.mark.parametrize("module,label,folds,held,least", [(quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.85)])
def test_classifiers(spark, nasty, nothing, labels, module, label, folds, held, least):
    got = module.report(read(spark, MEDIUM, "documents"), read(spark, MEDIUM, "labels"))
    rows = got.join(read(spark, MEDIUM, "labels"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % folds == held) == h for i, h in zip(rows.doc_id, rows.held_out))
    assert ((rows.score >= module.THRESHOLD).astype(int) == rows.predicted).all() and rows.score.between(0, 1).all()
    out = rows[rows.held_out]
    assert auc(out[label].to_numpy(), out.score.to_numpy()) > least
    odd = module.report(nasty, labels).collect()
    assert len(odd) == nasty.count() and all(0 <= r.score <= 1 for r in odd)
    assert module.report(nothing, labels).count() == 0
    none = module.report(nasty, labels.where("false")).select("score").distinct().collect()
    assert len(none) == 1


def test_interactions_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(bits=6, rank=3)
    m.w, m.v = rng.normal(size=m.size), rng.normal(size=(m.size, 3))
    words = rng.integers(0, 1 << 63, 7).astype(np.uint64)
    idx, val, at = m.rows(words, np.array([0, 7]), np.ones((1, quality.STATS)))
    x = collections.Counter()
    plain = sum(m.w[i] * v for i, v in zip(idx, val)) + sum((m.v[idx[a]] @ m.v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
    assert m.margins(idx, val, at)[0][0] == pytest.approx(plain)
    assert x == collections.Counter()


def test_grammar():
    import pyarrow as pa

    from moraline.llm import _text as tx

    g = toxicity.Grammar(np.array([tx.word_hash("scum")], np.uint64), np.array([4.0]))
    texts = ["scum", "not scum", "you scum", "they said scum", "not here. scum", "nothing", None, "SCUM, scum"]
    rows, _, score, _, n = g.paths(pa.record_batch({"text": texts}))
    by = dict(zip(rows.tolist(), score.tolist()))
    assert n == 8 and by[0] == 4.0 and by[1] == 2.0 and by[2] == pytest.approx(4.6) and by[4] == 4.0 and by.get(5, 0) == 0 and by[7] == 8.0
    assert by[3] < by[2]


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_language_model(spark, nasty, nothing):
    docs = read(spark, SMALL, "documents")
    got = backoff.report(docs).collect()
    tokens = {r.doc_id: WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (r.text or "").encode())) + [None] for r in docs.collect()}
    c = collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(t)
    n, v = sum(c.values()), len(c)
    for r in got:
        t = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n) and r.base_score == pytest.approx(base)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = backoff.report(nasty).collect()
    assert len(odd) == nasty.count() and all(math.isfinite(r.score) for r in odd)
    assert backoff.report(nothing).count() == 0


def test_probabilities_sum_to_one():
    """Over all words seen and the class of unseen ones, after any history."""
    import pyarrow as pa

    from moraline.llm import _text as tx

    m = backoff.Automaton.of(pa.record_batch({"text": ["a b a b a c", "a b c", "b b a", "a b"] * 3}))
    seen = [tx.word_hash(w) for w in "abc"]
    for history in ("", "a", "b", "c", "a b", "b a", "zz a", "b zz"):
        t, begin = backoff.tokens(pa.record_batch({"text": [history]}))
        total = 0.0
        for w in [*seen, int(backoff.END), 12345]:
            own = np.r_[t[:-1], np.array([w], np.uint64)]
            weight, _ = m.read(np.r_[own, t[-1:]], np.array([0, len(own) + 1]))
            total += 10 ** weight[-2]
        assert total == pytest.approx(1.0, abs=1e-9)


def brute_scores(rows):
    """Log10-probabilities from counts of all n-grams of the training texts."""
    tokens = {i: ["END", *WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())), "END"] for i, text in rows}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = {k: collections.Counter(g for t in train for g in zip(*(t[j:] for j in range(k)))) for k in (2, 3)}
    c[1] = collections.Counter((w,) for t in train for w in t[1:])
    total = sum(c[1].values())

    def p(g):
        if len(g) == 1:
            return (c[1][g] - 0.75) / total if c[1][g] else 0.75 * len(c[1]) / total
        h = c[len(g) - 1][g[:-1]]
        share = (h - 1) / (h - 1 + math.sqrt(h)) if h > 1 else 0
        return share * c[len(g)][g] / max(h, 1) + (1 - share) * p(g[1:])

    return {i: sum(math.log10(p(tuple(t[max(j - 2, 0) : j + 1]))) for j in range(1, len(t))) for i, t in tokens.items()}, total


def test_scores_by_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    want, _ = brute_scores([(r.doc_id, r.text or "") for r in docs.collect()])
    got = {r.doc_id: r.score for r in backoff.report(docs).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6) for i in want)


def test_many_slices(spark, monkeypatch):
    """Slices of a few texts each, texts that fill one alone, and more owners than there are keys."""
    monkeypatch.setattr(backoff, "SLICE", 2_000)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 300)))) for i in range(120)] + [(500, "a b " * 3_000)]
    want, _ = brute_scores(rows)
    got = {r.doc_id: r.score for r in backoff.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6) for i in want)


def test_sorting_in_parts(spark, monkeypatch):
    """Many parts for a few n-grams, and several slices in a task."""
    monkeypatch.setattr(backoff, "SLICE", 2_000)
    monkeypatch.setattr(backoff, "SORTED", 50)
    monkeypatch.setattr(backoff, "partitions", lambda spark: 3)
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, rng.integers(0, 300)))) for i in range(120)] + [(500, "a b " * 3_000)]
    want, _ = brute_scores(rows)
    got = {r.doc_id: r.score for r in backoff.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6) for i in want)


def test_memory_of_a_slice():
    """Reading a slice takes less than 45 bytes for each of its n-grams."""
    import tracemalloc

    from moraline.llm import _text as tx

    begin = np.arange(0, 600_001, 600)
    t = tx.mix(np.random.default_rng(11).integers(1, 1 << 40, begin[-1]).astype(np.uint64))
    t[begin[:-1]] = t[begin[1:] - 1] = backoff.END
    keys = np.unique(np.concatenate([k for _, k in backoff.grams(t, begin)]))
    m = backoff.Automaton(None, np.arange(len(keys)), 10**6, len(keys))
    tracemalloc.start()
    try:
        got = m.occurrences(t, begin)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for (at, key), c in zip(backoff.grams(t, begin), got, strict=True):
        assert (c[at] == np.searchsorted(keys, key)).all()
    assert most < 45 * 3 * len(t)


def test_texts_that_occur_twice_score_apart(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 80) % 4_000)) for i in range(300)]
    twice = {*range(40), *range(1000, 1040)}
    got = backoff.report(spark.createDataFrame(rows + [(1000 + i, rows[i][1]) for i in range(40)], "doc_id long, text string")).collect()
    mean = {r.doc_id: r.score / r.n_tokens for r in got if not r.held_out}
    once = np.percentile([v for i, v in mean.items() if i not in twice], 95)
    assert np.mean([v > once for i, v in mean.items() if i in twice and zlib.crc32(str((i + 1000) % 2000).encode()) % 5 != 1]) > 0.9


def test_rare_grams_of_a_large_table_are_states(spark):
    """Brute force over every n-gram, on so many tokens that a share of them is more than 2."""
    filler = " ".join(["f g"] * 2_500)
    rows = [(i, filler) for i in range(400)] + [(1000 + i, f"u{i} p q r s v{i % 7}") for i in range(12)] + [(2000 + i, f"p q r x{i} q r s p q") for i in range(10)]
    want, total = brute_scores(rows)
    assert total * 1e-6 > 1 and total * 2e-6 > 2
    got = {r.doc_id: r.score for r in backoff.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-6) for i in want)


def test_queries_with_small_first_leaves_have_all_rows(spark):
    """Most vectors are in tight clusters, so one visit reaches nearly all neighbours of the probes; the others' leaves hold few."""
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(16)[:8], 500, axis=0) + rng.normal(size=(4000, 16)) * 1e-3
    x[::400] = -np.eye(16)[rng.integers(8, 16, 10)] * 50 + rng.normal(size=(10, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    n = collections.Counter(r.query_id for r in neighbours.search(df, recall=0.0).collect())
    assert n == {i: 20 for i in range(0, 4000, 20)}


def test_an_id_that_repeats_counts_once(spark):
    """30 rows of one id lead every list: the other places go to other ids."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(100, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1001, (x.sum(0) * (5 + k)).tolist()) for k in range(30)] + [(0, (x[0] * 2).tolist())]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), recall=1.0).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r.vec_id)
    assert {q: len(v) for q, v in by.items()} == {q: 20 for q in range(0, 100, 20)} and all(len(set(v)) == 20 for v in by.values())
    assert all(r.score == max((np.array(v) * np.array(min(w for i, w in rows if i == r.query_id))).sum() for i, v in rows if i == r.vec_id) for r in got)


def test_neighbours(spark, nothing):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 3), (1004, [None] * 16), (None, x[0].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.search(df, sample=300, probes=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(float)
    hit = 0
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        best = [int(i) for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(s[i] == v for i, v in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        hit += len({i for i, _ in got[q]} & set(best))
    assert set(got) == set(range(0, 600, 20)) and hit / 600 >= 0.9
    tied = [i for i, v in got[100] if v == (x[100] * x[100]).sum()]
    assert tied == list(range(101, 121))
    few = neighbours.search(df.where("vec_id < 4")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert neighbours.search(df.where("vec_id >= 1000")).count() == 0


def test_columns_named_like_results(spark, nasty, labels):
    kept = quality.keep_good(nasty, labels, threshold=0.0)
    assert kept.columns == nasty.columns and sorted(map(str, kept.collect())) == sorted(map(str, nasty.collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_tables(nasty, nothing, labels, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows and more columns; or no rows at all."""
    import corpus_pipeline as cp

    docs = nothing if empty else nasty
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = cp.run(docs.sparkSession, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()} and (not empty or not got)
    for _, stage in cp.STAGES:
        docs = stage(docs.sparkSession, docs, str(tmp_path))
    assert (docs.count() == 0) == empty or not empty


def test_pipeline(spark):
    import corpus_pipeline as cp
    from moraline.llm import bpe
    from moraline.llm._spark import written
    from tests.llm.test_texts import brute_components, covered

    docs = read(spark, SMALL, "documents")
    kept = written(cp.quality_filter(spark, docs, SMALL))
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = written(cp.near_duplicates(spark, kept, SMALL))
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)
    texts = [(r.doc_id, r.text.encode()) for r in one.collect()]
    want = {i: bytes(np.frombuffer(b, np.uint8)[~g]).decode("utf-8", "ignore") for (i, b), g in zip(texts, covered([b for _, b in texts], 200))}
    cut = written(cp.repeated_passages(spark, one, SMALL))
    assert {r.doc_id: r.text for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())
    mix = written(cp.source_mix(spark, cut, SMALL))
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= set(want)
    ids = cp.token_ids(spark, mix, SMALL).collect()
    model = bpe.Bpe()
    for r in ids:
        assert r.ids == model.encode(want[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert collections.Counter(r.doc_id for r in ids) == collections.Counter(r.doc_id for r in mix.select("doc_id").collect())
    assert [n for n, _ in cp.STAGES] and cp.ORACLE_SQL is None
    assert mix.where(F.col("text").isNull()).count() == 0
