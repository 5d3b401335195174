"""Re-ranking all segments of a sentence together.

Entries and vectors are joined to the candidates first, so a sentence's group holds all
it needs and nothing is broadcast. What follows depends on the order of segments (each
one sees the tops that were changed before it), so it runs as a grouped map.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dictionary

WEIGHTS, MAX_FREQUENCY, PASSES, KEPT, JOINT = (0.3, 0.5, 0.2), 9000, 3, 20, (0.7, 0.15)


def cosine(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return 0.0
    a, b = a.astype(float), b.astype(float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n >= 1e-10 else 0.0


@dataclass
class Segment:
    """options: (surface, reading, conf, frequency); ranked: options with scores, best first; selected: a place in it."""

    hangul: str
    options: list[tuple[str, str, float, int]]
    ranked: list[tuple[float, str, str]] = field(default_factory=list)
    selected: int = 0

    def surface(self) -> str:
        return self.ranked[self.selected][1] if self.ranked else self.hangul

    def turn(self, by: int) -> None:
        """The next (1) or previous (-1) candidate, round and round."""
        if self.ranked:
            self.selected = (self.selected + by) % len(self.ranked)


class SentenceBuffer:
    def __init__(self, vectors: dict[str, np.ndarray], committed: list[str] | None = None, passes: int = PASSES):
        self.vectors, self.committed, self.passes, self.segments = vectors, list(committed or []), passes, []

    def add(self, segment: Segment) -> None:
        self.segments.append(segment)
        self.rerank()

    def pop(self) -> Segment | None:
        out = self.segments.pop() if self.segments else None
        if self.segments:
            self.rerank()
        return out

    def composed(self, mark: str = "{}") -> str:
        return "".join(mark.format(s.surface()) for s in self.segments)

    def clear(self) -> None:
        """Drops the segments; what was committed stays."""
        self.segments = []

    def commit(self) -> str:
        out = self.composed()
        self.committed = (self.committed + [s.surface() for s in self.segments])[-KEPT:]
        self.segments = []
        return out

    def context(self, words: list[str]) -> np.ndarray | None:
        """Vectors weighted by 1 / distance from the end, in single precision; None without any."""
        some = [(self.vectors[w], np.float32(1 / (len(words) - i))) for i, w in enumerate(words) if w in self.vectors]
        if not some:
            return None
        out = sum(v.astype(np.float32) * w for v, w in some) / sum(w for _, w in some)
        return out if (np.abs(out) >= 1e-10).any() else None

    def rank(self, segment: Segment, words: list[str]) -> list[tuple[float, str, str]]:
        ctx, (a, b, c) = self.context(words), WEIGHTS
        rows = []
        for surface, reading, conf, frequency in segment.options:
            near = (cosine(self.vectors[surface], ctx) + 1) / 2 if ctx is not None and surface in self.vectors else 0.5
            rows.append((a * conf + b * near + c * frequency / MAX_FREQUENCY, surface, reading))
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        return [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][1] != r[1]]

    def rerank(self) -> None:
        for s in self.segments:
            s.ranked, s.selected = self.rank(s, self.committed), 0
        for s, t in zip(self.segments, self.segments[1:], strict=False):
            self._jointly(s, t)
        self._settle(None)

    def select(self, segment: int, candidate: int) -> None:
        """Pins a segment's candidate and ranks the others anew."""
        if segment < len(self.segments):
            self.segments[segment].selected = candidate
            self._settle(segment)

    def _settle(self, pinned: int | None) -> None:
        for _ in range(self.passes):
            changed = False
            for i, s in enumerate(self.segments):
                if i != pinned:
                    old = s.ranked[0][1] if s.ranked else ""
                    s.ranked = self.rank(s, self.committed + [t.surface() for j, t in enumerate(self.segments) if j != i])
                    s.selected = 0
                    changed |= old != (s.ranked[0][1] if s.ranked else "")
            if not changed:
                return

    def _jointly(self, s: Segment, t: Segment) -> None:
        """The best pair of the two first candidates of neighbours comes to the front."""
        if len(s.ranked) < 2 or len(t.ranked) < 2:
            return
        near, own = JOINT
        pairs = [(near * cosine(self.vectors.get(s.ranked[i][1]), self.vectors.get(t.ranked[j][1])) + own * (s.ranked[i][0] + t.ranked[j][0]), -i, -j) for i in (0, 1) for j in (0, 1)]
        _, i, j = max(pairs)
        for seg, k in ((s, -i), (t, -j)):
            if k:
                seg.ranked[0], seg.ranked[k] = seg.ranked[k], seg.ranked[0]


def reranked(segments: DataFrame, entries: DataFrame, vectors: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """sid, pos, hangul, surface, reading, score of segments (sid, pos, hangul, candidates array<struct<hira, conf>>); committed: (sid, words)."""
    each = segments.select("sid", "pos", "hangul", F.explode_outer("candidates").alias("c")).select("sid", "pos", "hangul", "c.hira", "c.conf")
    found = dictionary.with_self(each.where("hira is not null"), entries)
    own = found.join(vectors.select(F.col("word").alias("surface"), "vector"), "surface", "left").select("sid", "pos", "hangul", "surface", "hira", "conf", "frequency", "vector")
    if committed is not None:
        words = committed.select("sid", F.posexplode("words").alias("pos", "surface"))
        past = words.join(vectors.select(F.col("word").alias("surface"), "vector"), "surface", "left")
        own = own.unionByName(past.select("sid", F.col("pos"), F.lit(None).cast("string").alias("hangul"), "surface", F.lit(None).cast("string").alias("hira"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("long").alias("frequency"), "vector"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vec = {s: np.asarray(v, np.float32) for s, v in zip(pdf.surface, pdf.vector, strict=True) if v is not None}
        past = pdf[pdf.hangul.isna()].sort_values("pos").surface.tolist()[-KEPT:]
        now = pdf[pdf.hangul.notna()].sort_values(["pos", "surface", "hira"])
        buffer = SentenceBuffer(vec, past)
        places = []
        for (pos, hangul), g in now.groupby(["pos", "hangul"], sort=True):
            places.append(pos)
            buffer.segments.append(Segment(hangul, list(zip(g.surface, g.hira, g.conf, g.frequency, strict=True))))
        buffer.rerank()
        rows = [(pdf.sid.iloc[0], p, s.hangul, s.surface(), s.ranked[s.selected][2], s.ranked[s.selected][0]) for p, s in zip(places, buffer.segments, strict=True)]
        return pd.DataFrame(rows, columns=["sid", "pos", "hangul", "surface", "reading", "score"])

    kind = dict(segments.dtypes)
    return own.groupBy("sid").applyInPandas(run, f"sid {kind['sid']}, pos {kind['pos']}, hangul string, surface string, reading string, score double")
