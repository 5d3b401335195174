"""Toxicity scores from a weighted finite-state pattern grammar.

Five small transducers read the symbols of a clause: insult and threat give weight to
words of the learned lexicon and to threat words, target remembers that somebody is
addressed, negation and reported speech remember that what follows is denied or quoted.
They are composed into one automaton over symbol classes whose arcs carry a factor for
the weight of the symbol read. A clause's score is the weight of its path; words outside
the grammar leave the state as it is, and clause marks reset it. A document's score is a
logistic of its clauses' total, its density, its largest clause and its matched clauses.

The insult lexicon (words and word beginnings with their log-odds, at their lower
confidence bound; the largest that fits a word counts) and the logistic are learned from a bounded sample of labelled rows; all texts are scored whole.
Defined results: null text is the empty text; without matches a text has the score of a
text without matched clauses; without labels of both kinds scores are the share of 1s.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import crc, labelled, share, texts

LIMIT, LEXICON, FOLDS, HELD_OUT, THRESHOLD = 40_000, 20_000, 3, 1, 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MARK = range(7)

# Closed-class words of the grammar, in the languages it is used for.
CLOSED = {
    THREAT: "kill hurt destroy burn beat stab shoot töten schlagen verbrennen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours he him she her they them du dich dir ihr euch er ihn tu toi vous il lui elle ils tú ti te usted él ella ellos",
    NEGATION: "not no never isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says told claimed reported quoted wrote sagte sagt schrieb dit disait écrit dijo dice escribió",
}
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".!?;\n"]] = True


@dataclass
class Transducer:
    """States 0..n-1; step[class] gives each state's next state, factor[class] what an arc multiplies."""

    step: dict[int, list[int]]
    factor: dict[int, list[float]] = field(default_factory=dict)
    states: int = 2


def grammar(denied: float = 0.5, quoted: float = 0.7, aimed: float = 1.15) -> list[Transducer]:
    return [
        Transducer({}, {INSULT: [1.0]}, 1),
        Transducer({}, {THREAT: [0.2]}, 1),
        Transducer({TARGET: [1, 1]}, {INSULT: [1.0, aimed], THREAT: [0.5, 1.0]}),
        Transducer({NEGATION: [1, 1]}, {INSULT: [1.0, denied], THREAT: [1.0, denied]}),
        Transducer({REPORT: [1, 1]}, {INSULT: [1.0, quoted], THREAT: [1.0, quoted]}),
    ]


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product automaton: next state and factor by state and class; state 0 is the start."""
    states = list(product(*(range(p.states) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    step, factor = np.zeros((len(states), 7), np.int32), np.zeros((len(states), 7))
    for s, c in product(states, range(7)):
        to = tuple(0 if c == MARK else p.step.get(c, range(p.states))[x] for p, x in zip(parts, s, strict=True))
        step[number[s], c] = number[to]
        if c in (INSULT, THREAT):
            factor[number[s], c] = np.prod([p.factor.get(c, [1.0] * p.states)[x] for p, x in zip(parts, s, strict=True)])
    return step, factor


FEATURES = 4


class Grammar:
    def __init__(self, words: np.ndarray, weights: np.ndarray, **options):
        closed = {tx.word_hash(w): c for c, ws in CLOSED.items() for w in ws.split()}
        known = set(words.tolist())
        extra = np.array([h for h in closed if h not in known], np.uint64)
        keys = np.r_[words.astype(np.uint64), extra]
        cls = np.r_[np.full(len(words), INSULT), [closed[int(h)] for h in extra]].astype(np.int8)
        weight = np.r_[weights, np.ones(len(extra))]
        order = np.argsort(keys)
        self.keys, self.cls, self.weight = keys[order], cls[order], weight[order]
        self.step, self.factor = compose(grammar(**options))
        self.coef, self.mean, self.scale = np.zeros(1 + FEATURES), np.zeros(FEATURES), np.ones(FEATURES)

    def clauses(self, piece: pa.RecordBatch) -> np.ndarray:
        """For each row: log of its total weight, weight for 100 words, largest clause, share of matched clauses."""
        words_of, clause, score, n_words, rows = self.paths(piece)
        total = np.bincount(words_of, score, rows)
        top = np.zeros(rows)
        np.maximum.at(top, words_of, score)
        hit = np.bincount(words_of, score > 0, rows)
        n = np.maximum(n_words, 1)
        return np.c_[np.log1p(total), np.minimum(100 * total / n, 60.0), top, np.minimum(100 * hit / n, 20.0)]

    def paths(self, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Matched clauses of a piece: their rows, their numbers, the weights of their paths; words of each row; rows."""
        data, offs = tx.flat(piece.column("text"))
        starts, h, first, stems = bare_words(data, offs)
        rows, n_words = len(offs) - 1, np.diff(first)
        at = tx.found(self.keys, h)
        for of, stem in stems:
            got = tx.found(self.keys, stem)
            some = got >= 0
            of, got = of[some], got[some]
            now = at[of]
            better = (now < 0) | ((self.cls[now] == INSULT) & (self.weight[got] > self.weight[now]))
            at[of[better]] = got[better]
        here = np.flatnonzero(at >= 0)
        if not len(here):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), n_words, rows
        cls, weight = self.cls[at[here]], self.weight[at[here]]
        marks = np.cumsum(_MARKS[data])
        row = np.searchsorted(first, here, "right") - 1
        clause = marks[starts[here]] + row  # a new row is a new clause too
        begin = np.flatnonzero(np.r_[True, clause[1:] != clause[:-1]])
        size = np.diff(np.r_[begin, len(clause)])
        state, score = np.zeros(len(begin), np.int32), np.zeros(len(begin))
        going = np.arange(len(begin))
        for k in range(int(size.max())):  # all clauses take their k-th symbol together
            going = going[size[going] > k]
            i = begin[going] + k
            score[going] += self.factor[state[going], cls[i]] * weight[i]
            state[going] = self.step[state[going], cls[i]]
        return row[begin], clause[begin], score, n_words, rows

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Grammar:
        """Logistic regression by Newton steps that are halved until the loss falls."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.coef[0] = np.log(share / (1 - share))
        if len(y) < 2 or y.min() == y.max():
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z, pull = np.c_[np.ones(len(x)), (x - self.mean) / self.scale], np.r_[0, np.full(FEATURES, ridge)]

        def loss(c: np.ndarray) -> float:
            m = z @ c
            return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * pull @ c**2)

        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-6), z.T @ (p - y) + pull * self.coef)
            rate, now = 1.0, loss(self.coef)
            while rate > 1e-4 and loss(self.coef - rate * step) > now:
                rate /= 2
            self.coef = self.coef - rate * step
            if np.abs(rate * step).max() < 1e-6:
                break
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + ((x - self.mean) / self.scale) @ self.coef[1:], -30, 30)))


_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


STEMS = (5, 7)


def bare_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts and hashes of words, where ASCII punctuation (apostrophes apart) separates words too, each row's first
    word, and for each length of STEMS the words with more bytes and the hashes of their beginnings."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), []
    data = np.where(_STOPS[data], np.uint8(32), data)
    starts, ends, h, first = tx.words(data, offs)
    lower = tx.LOWER[data]
    stems = []
    for n in STEMS:
        of = np.flatnonzero(ends - starts > n)
        stems.append((of, tx.mix(tx.word_hashes(lower, starts[of], starts[of] + n) ^ np.uint64(n))))
    return starts, h, first, stems


def _word_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of label 0 and of label 1 have each word; the item -1 - label counts the documents."""
    sides = [tx.Counts(1_000_000), tx.Counts(1_000_000)]
    docs = [0, 0]

    def out(side: int) -> pa.RecordBatch:
        keys, n = sides[side].flush()
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), side)), pa.array(n)], ["word", "label", "n"])

    for batch in rows:
        for piece in tx.pieces(batch):
            _, h, first, stems = bare_words(*tx.flat(piece.column("text")))
            spans = [(of, np.searchsorted(of, first), x) for of, x in stems]
            for i, y in enumerate(piece.column("label").to_pylist()):
                sides[y].add(tx.distinct(np.concatenate([h[first[i] : first[i + 1]], *(x[f[i] : f[i + 1]] for _, f, x in spans)])))
                docs[y] += 1
        for side in (0, 1):
            if sides[side].full():
                yield out(side)
    yield out(0)
    yield out(1)
    yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([0, 1]), pa.array(docs, pa.int64())], ["word", "label", "n"])


def lexicon(sample: DataFrame, most: int = LEXICON, surely: float = 1.5, least: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Words and weights: the ``most`` surest of those whose log-odds exceed ``least`` by ``surely`` standard errors."""
    n = sample.mapInArrow(tx.trimmed(_word_counts), "word long, label long, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    whole = n.where("word is null").first()
    if whole is None or not whole.toxic or not whole.clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    odds = F.log((F.col("toxic") + 0.5) / (whole.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (whole.clean + 1.0))
    weight = odds - surely * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    got = n.where("word is not null and toxic >= 3").select("word", weight.alias("weight")).where(F.col("weight") > least).orderBy(F.desc("weight"), "word").limit(most).toArrow()
    return got.column("word").to_numpy().view(np.uint64), got.column("weight").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Grammar:
    """The grammar for ``labels.toxic``: one half of the sample gives the lexicon, the other the logistic."""
    sample = labelled(docs, labels, "toxic", FOLDS, HELD_OUT, limit)
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) < 2
    model = Grammar(*lexicon(sample.where(half)))
    sent = share(docs.sparkSession, model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for piece in tx.pieces(batch):
                x = sent.value.clauses(piece)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES)), piece.column("label")], [*"abcd", "label"])

    got = sample.where(~half).mapInArrow(tx.trimmed(run), "a double, b double, c double, d double, label int").toArrow()
    x = np.c_[tuple(got.column(c).to_numpy() for c in "abcd")] if got.num_rows else np.zeros((0, FEATURES))
    return model.fit(x, got.column("label").to_numpy().astype(float))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on, which counts as reached) for every document; the scoring itself is one scan."""
    docs = texts(docs)
    sent = share(docs.sparkSession, fit(docs, labels, limit))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for piece in tx.pieces(batch):
                s = pa.array(sent.value.scores(sent.value.clauses(piece)), pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), s], ["doc_id", "score"])

    out = docs.mapInArrow(tx.trimmed(run), "doc_id long, score double")
    return out.select("doc_id", (F.pmod(crc(), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
