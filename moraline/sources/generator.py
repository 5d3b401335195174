"""Synthetic sentences from templates and a vocabulary.

exact() follows one sequence of a linear congruential generator, as draws depend on all
before them, in one partition. scaled() seeds every sentence on its own and is spread
over the cluster, as is its vocabulary; it is a different corpus of the same kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import kana, words
from .scratch import written

# The generator's constants and the templates; capital words are slots.
MULTIPLIER, INCREMENT, MASK, SEED = 6364136223846793005, 1442695040888963407, (1 << 64) - 1, 42
TEMPLATES = [
    ("copula", "<Subject>は<Noun>です"),
    ("i-adjective", "<Subject>が<IAdjective>です"),
    ("na-adjective", "<Subject>は<NaAdjective>です"),
    ("verb-transitive", "<Noun>を<VerbMasu>"),
    ("verb-locative", "<Place>で<Noun>を<VerbMasu>"),
    ("verb-dative", "<Noun>に<VerbMasu>"),
    ("conjunction", "<Noun>と<Noun>を<VerbMasu>"),
    ("possessive", "<Subject>の<Noun>が<IAdjective>です"),
    ("adverbial", "<Adverb><IAdjective><Noun>です"),
    ("temporal", "<Time>に<Noun>を<VerbMasu>"),
    ("range", "<Place>から<Place>まで<VerbMasu>"),
    ("inclusive", "<Subject>も<VerbMasu>"),
    ("te-conjunction", "<Noun>を<VerbTe><Noun>を<VerbMasu>"),
    ("negative", "<Subject>は<VerbNai>"),
    ("past", "<Subject>は<VerbTa>"),
    ("ditransitive", "<Noun>に<Noun>を<VerbMasu>"),
    ("property", "<Subject>は<Noun>が<NaAdjective>です"),
    ("comparative", "<Subject>は<Noun>より<IAdjective>です"),
]
POS_OF = {"Noun": "Noun", "Subject": "Noun", "IAdjective": "IAdjective", "Adverb": "Adverb", "Verb": "Verb", "Action": "Verb", "VerbMasu": "Verb", "VerbTe": "Verb", "VerbTa": "Verb", "VerbNai": "Verb"}
CATEGORY_OF = {"Time": "Time", "Place": "Place", "Food": "Food"}
FORM_OF = {"VerbMasu": "masu", "VerbTe": "te", "VerbTa": "ta", "VerbNai": "nai"}
ATTEMPTS = 3
_SCHEMA = "sid long, category string, words array<struct<surface:string,reading:string,hangul:string>>"


class Draws:
    def __init__(self, seed: int):
        self.state = seed & MASK

    def below(self, n: int) -> int:
        if n == 0:
            return 0
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        return self.state % n


def parsed(pattern: str) -> list[tuple[bool, str]]:
    """(is slot, text) of a template's parts."""
    return [(i % 2 == 1, p) for i, p in enumerate(pattern.replace(">", "<").split("<")) if p]


PARTS = [(name, parsed(p)) for name, p in TEMPLATES]


def lists(compat: bool = True) -> dict[str, str]:
    """For each slot of the templates the list of words it draws from: those of a part of speech, or of a category."""
    pos = POS_OF | {"NaAdjective": "IAdjective" if compat else "NaAdjective"}
    slots = {s for _, parts in PARTS for slot, s in parts if slot}
    return {s: f"pos:{pos[s]}" if s in pos else f"category:{CATEGORY_OF[s]}" for s in slots}


def planned(sizes: dict[str, int], draws: Draws) -> tuple[int, list[tuple[str, int]]] | None:
    """A template's number and for each of its slots a word's place in the slot's list, by the lists' sizes; None where a slot has no word."""
    template, out = draws.below(len(PARTS)), []
    for slot, text in PARTS[template][1]:
        if slot:
            if not sizes.get(text):
                return None
            out.append((text, draws.below(sizes[text])))
    return template, out


def assembled(template: int, chosen: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """A template's sentence with words (surface, reading) in its slots. Literals join the word before, whose reading stays as it was."""
    name, parts = PARTS[template]
    out, chosen = [], iter(chosen)
    for slot, text in parts:
        if slot:
            surface, reading = next(chosen)
            surface = words.conjugate(reading, FORM_OF[text]) if text in FORM_OF else surface
            out.append({"surface": surface, "reading": reading, "hangul": kana.to_hangul(reading)})
        elif out:
            out[-1]["surface"] += text
        else:
            out.append({"surface": text, "reading": text, "hangul": kana.to_hangul(text)})
    return name, out


class Grammar:
    """Templates over a vocabulary (surface, reading, pos, category), in the order of its rows."""

    def __init__(self, vocab: list[tuple[str, str, str, str]], compat: bool = True):
        self.of = {s: [v[:2] for v in vocab if list_ in (f"pos:{v[2]}", f"category:{v[3]}")] for s, list_ in lists(compat).items()}
        self.sizes = {s: len(of) for s, of in self.of.items()}

    def sentence(self, draws: Draws) -> tuple[str, list[dict]] | None:
        plan = planned(self.sizes, draws)
        return plan and assembled(plan[0], [self.of[s][n] for s, n in plan[1]])


def sequence(vocab: list[tuple[str, str, str, str]], count: int, seed: int = SEED, compat: bool = True) -> Iterator[tuple[int, str, list[dict]]]:
    grammar, draws, n = Grammar(vocab, compat), Draws(seed), 0
    for _ in range(ATTEMPTS * count):
        if n == count:
            return
        made = grammar.sentence(draws)
        if made:
            yield n, *made
            n += 1


def rows_of(vocab: DataFrame, most: int = 200_000) -> list[tuple[str, str, str, str]]:
    """A vocabulary of checked size, in load order."""
    got = vocab.orderBy("load_seq").select("surface", "reading", "pos", "category").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"vocabularies of templates have at most {most} rows")
    return [tuple(r) for r in got]


class _Reader(DataSourceReader):
    def __init__(self, options: dict, vocab: list):
        self.options, self.vocab = options, vocab

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for sid, name, made in sequence(self.vocab, int(self.options.get("count", 1000)), int(self.options.get("seed", SEED))):
            yield sid, name, [(w["surface"], w["reading"], w["hangul"]) for w in made]


def register(spark: SparkSession, vocab: DataFrame, name: str = "template_sentences") -> str:
    """Registers a batch source that generates sentences over ``vocab``: spark.read.format(name).option("count", n).option("seed", s)."""
    known = rows_of(vocab)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return _SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(dict(self.options), known)

    spark.dataSource.register(Source)
    return name


def exact(vocab: DataFrame, count: int, seed: int = SEED, compat: bool = True) -> DataFrame:
    known = rows_of(vocab)

    def run(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for row in sequence(known, count, seed, compat):
            rows.append(row)
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=["sid", "category", "words"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["sid", "category", "words"])

    return vocab.sparkSession.range(1, numPartitions=1).mapInPandas(run, _SCHEMA)


def numbered(vocab: DataFrame, compat: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """list, number, surface, reading of a vocabulary in load order, and how many words each list has.

    Ranges of rows are numbered each on their own, after the words of the ranges before them.
    """
    order = ["load_seq", "surface", "reading", "list"]
    each = vocab.select("load_seq", "surface", "reading", F.explode(F.array(F.concat(F.lit("pos:"), "pos"), F.concat(F.lit("category:"), "category"))).alias("list"))
    each = each.where(F.col("list").isin(*set(lists(compat).values())))
    held = written(each.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes, before = {}, []
    for r in held.groupBy("part", "list").count().orderBy("part", "list").collect():  # some rows for each partition
        before.append((r["part"], r["list"], sizes.get(r["list"], 0)))
        sizes[r["list"]] = sizes.get(r["list"], 0) + r["count"]
    first = F.broadcast(vocab.sparkSession.createDataFrame(before, "part int, list string, first long"))
    place = F.row_number().over(Window.partitionBy("part", "list").orderBy("load_seq", "surface", "reading"))
    return held.withColumn("place", place).join(first, ["part", "list"]).select("list", (F.col("first") + F.col("place") - 1).alias("number"), "surface", "reading"), sizes


def scaled(vocab: DataFrame, count: int, seed: int = SEED, compat: bool = True) -> DataFrame:
    """Draws need the sizes of the lists only; words come by a join, so the vocabulary may have any size."""
    known, sizes = numbered(vocab, compat)
    of = lists(compat)
    sizes = {s: sizes.get(list_, 0) for s, list_ in of.items()}

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sid, h in zip(pdf.id, pdf.h, strict=True):
                draws = Draws(int(h))
                made = next((m for m in (planned(sizes, draws) for _ in range(ATTEMPTS)) if m), None)
                if made:
                    rows += [(sid, made[0], i, of[s], n) for i, (s, n) in enumerate(made[1])]
            yield pd.DataFrame(rows, columns=["sid", "template", "place", "list", "number"])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(sid, *assembled(t, [(w["surface"], w["reading"]) for w in chosen])) for sid, t, chosen in zip(pdf.sid, pdf.template, pdf.chosen, strict=True)]
            yield pd.DataFrame(rows, columns=["sid", "category", "words"])

    ids = vocab.sparkSession.range(count).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    slots = ids.mapInPandas(plan, "sid long, template int, place int, list string, number long").join(known, ["list", "number"])
    chosen = slots.groupBy("sid", "template").agg(F.sort_array(F.collect_list(F.struct("place", "surface", "reading"))).alias("chosen"))
    return chosen.mapInPandas(fill, _SCHEMA)
