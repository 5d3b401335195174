"""Command line: convert words, talk in a loop, and build models of a sentence file.

    python -m moraline 사쿠라
    python -m moraline --models DIR 사쿠라
    python -m moraline [--models DIR] --interactive
    python -m moraline build SENTENCES.jsonl DIR [--dim N] [--rounds N]
    python -m moraline generate VOCABULARY.csv DIR [--count N] [--dim N] [--rounds N]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import decode
from .plans import build
from .sources import generator, readers


def session() -> SparkSession:
    return SparkSession.builder.appName("moraline").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def answers(text: str, converter: build.Converter | None, most: int = 10) -> list[tuple[str, float]]:
    """What is shown for one input: candidates of the models, or readings by letters."""
    if converter is None:
        return [(hira, conf) for hira, _, conf in decode.rule_based(text, most)]
    spark = converter.entries.sparkSession
    rows = converter.convert(spark.createDataFrame([(0, text)], "id long, hangul string")).orderBy("rank").collect()
    return [(r.surface, r.score) for r in rows]


def show(text: str, converter: build.Converter | None, out) -> None:
    print(text, file=out)
    for i, (word, score) in enumerate(answers(text, converter), 1):
        print(f"  {i}. {word}  ({score:.3f})", file=out)


def main(args: list[str] | None = None, lines=None, out=None) -> int:
    args, lines, out = sys.argv[1:] if args is None else args, lines or sys.stdin, out or sys.stdout
    if args[:1] and args[0] in ("build", "generate"):
        p = argparse.ArgumentParser(prog=f"moraline {args[0]}")
        p.add_argument("source")
        p.add_argument("models")
        p.add_argument("--count", type=int, default=100_000)
        p.add_argument("--dim", type=int, default=64)
        p.add_argument("--rounds", type=int, default=50)
        o = p.parse_args(args[1:])
        spark = session()
        rows = readers.sentences(spark, o.source) if args[0] == "build" else generator.scaled(readers.vocabulary(spark, o.source), o.count)
        for name, size in build.build(rows, o.models, build.Config(dim=o.dim, rounds=o.rounds)).items():
            print(f"{name}: {size}", file=out)
        return 0
    p = argparse.ArgumentParser(prog="moraline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--models")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("text", nargs="*")
    o = p.parse_args(args)
    converter = build.Converter.load(session(), o.models) if o.models else None
    for text in o.text:
        show(text, converter, out)
    if o.interactive:
        for line in lines:
            if line.strip() in ("q", "quit", "exit"):
                break
            if line.strip():
                show(line.strip(), converter, out)
    if not o.text and not o.interactive:
        p.print_help(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
