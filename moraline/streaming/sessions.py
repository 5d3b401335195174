"""Keystrokes composed into syllables, rolling contexts, sentence buffers, selection counts and clicks as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import jamo
from ..operators import dictionary
from ..operators.sentence import Segment, SentenceBuffer
from ..sources import readers

CONTEXT = 20


def composing(keys: DataFrame) -> DataFrame:
    """session, seq, text, committed for keys (session, seq, letter): letters compose, BACKSPACE takes one back, ESCAPE clears, ENTER commits.

    The state of a session is its letters. Rows of one batch are taken in the order of seq.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        letters = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, letter in zip(pdf.seq, pdf.letter, strict=True):
            committed = None
            if letter == "BACKSPACE":
                letters = letters[:-1]
            elif letter == "ESCAPE":
                letters = []
            elif letter == "ENTER":
                committed, letters = jamo.compose_letters("".join(letters)), []
            else:
                letters.append(letter)
            out.append((key[0], seq, jamo.compose_letters("".join(letters)), committed))
        state.update(("".join(letters),))
        yield pd.DataFrame(out, columns=["session", "seq", "text", "committed"])

    return keys.groupBy("session").applyInPandasWithState(step, "session string, seq long, text string, committed string", "letters string", "append", GroupStateTimeout.NoTimeout)


def contexts(words: DataFrame, most: int = CONTEXT) -> DataFrame:
    """session, seq, words: the last ``most`` words before each one of a stream (session, seq, word)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, word in zip(pdf.seq, pdf.word, strict=True):
            out.append((key[0], seq, list(past)))
            past = [*past, word][-most:]
        state.update((past,))
        yield pd.DataFrame(out, columns=["session", "seq", "words"])

    return words.groupBy("session").applyInPandasWithState(step, "session string, seq long, words array<string>", "words array<string>", "append", GroupStateTimeout.NoTimeout)


def _kept(buffer: SentenceBuffer) -> str:
    segments = [[s.hangul, s.options, s.ranked, s.selected] for s in buffer.segments]
    return json.dumps([buffer.committed, {w: v.tolist() for w, v in buffer.vectors.items()}, segments])


def _revived(text: str) -> SentenceBuffer:
    committed, vectors, segments = json.loads(text)
    out = SentenceBuffer({w: np.array(v, np.float32) for w, v in vectors.items()}, committed)
    out.segments = [Segment(h, [tuple(o) for o in options], [tuple(r) for r in ranked], selected) for h, options, ranked, selected in segments]
    return out


def sentences(events: DataFrame) -> DataFrame:
    """session, seq, text, committed for events (session, seq, action, hangul, options, segment, candidate): a sentence buffer for each session.

    Actions: add (a segment with its options, array<struct<surface, reading, conf, frequency, vector>>),
    pop, select (a candidate of a segment), clear, commit. The state has the segments, the
    vectors of their words and of the committed ones.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = _revived(state.get[0]) if state.exists else SentenceBuffer({})
        out = []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            committed = None
            if e.action == "add":
                options = list(e.options) if e.options is not None else []
                buffer.vectors |= {o["surface"]: np.array(o["vector"], np.float32) for o in options if o["vector"] is not None}
                buffer.add(Segment(e.hangul, [(o["surface"], o["reading"], float(o["conf"]), int(o["frequency"])) for o in options]))
            elif e.action == "pop":
                buffer.pop()
            elif e.action == "select":
                buffer.select(int(e.segment), int(e.candidate))
            elif e.action == "clear":
                buffer.clear()
            elif e.action == "commit":
                committed = buffer.commit()
                used = set(buffer.committed)
                buffer.vectors = {w: v for w, v in buffer.vectors.items() if w in used}
            out.append((key[0], e.seq, buffer.composed(), committed))
        state.update((_kept(buffer),))
        yield pd.DataFrame(out, columns=["session", "seq", "text", "committed"])

    return events.groupBy("session").applyInPandasWithState(step, "session string, seq long, text string, committed string", "buffer string", "append", GroupStateTimeout.NoTimeout)


def selection_counts(log: DataFrame) -> DataFrame:
    """Running counts of a selection stream; write in update or complete mode."""
    return dictionary.selections(log)


def clicks(requests: DataFrame) -> DataFrame:
    return readers.clicks(requests)
