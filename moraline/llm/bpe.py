"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round the rank of
every adjacent pair is found by binary search over the sorted pair keys, each word
merges all places of its lowest-ranked pair, and finished words leave the array.
Texts are cut into words by the vocabulary's own pattern; words that were met before
come from a bounded cache, so only new ones take part in rounds.

Defined results: null text is the empty text, which has no ids and decodes to the
empty text. The strings of added tokens inside a text become those tokens, as the
tokenizers library does unless told otherwise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import share

# Fixed value: the pattern that cuts a text into words for this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 300_000
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else one from U+0100 up."""
    out, spare = {}, 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out[chr(b) if plain else chr(spare)] = b
        spare += not plain
    return out


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Bpe:
    """One vocabulary file (tokenizers' JSON form) as arrays."""

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.first = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.first[b] = vocab[c]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        names |= {i: t.encode() for t, i in self.added.items()}
        self.bytes = [names.get(i, b"") for i in range(max(names) + 1)]
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(PATTERN).findall
        self.cache_words, self.cache = cache_words, {}

    def __reduce__(self):  # caches stay behind
        return _again, (self.__dict__ | {"cache": {}, "words": None},)

    def rounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (UTF-8 bytes and offsets, one more than words) in one array, and its offsets."""
        n = len(offsets) - 1
        sym, word = self.first[data], np.repeat(np.arange(n), np.diff(offsets))
        done = []
        while len(sym) > 1:
            key = sym[:-1].astype(np.int64) << 32 | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            lowest = np.minimum.reduceat(rank, start)
            live = np.repeat(lowest != _NONE, size)
            if not live.all():
                done.append((sym[~live], word[~live]))
            here = np.flatnonzero(rank == np.repeat(np.where(lowest == _NONE, -1, lowest), size))
            if not len(here):
                sym = sym[:0]
                break
            new_run = np.r_[True, np.diff(here) != 1]  # of a pair of equal symbols, every second place
            here = here[(np.arange(len(here)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]) % 2 == 0]
            sym[here] = self.merged[rank[here]]
            live[here + 1] = False
            sym, word = sym[live], word[live]
        if len(sym):
            done.append((sym, word))
        if not done:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        ids, of = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return ids[np.argsort(of, kind="stable")], np.r_[0, np.cumsum(np.bincount(of, minlength=n))]

    def learn(self, texts: list[list[str]]) -> None:
        """Puts all words of ``texts`` into the cache: decimal ids joined by commas, and the bytes they decode to."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
            self.cache |= {t: (str(i), self.bytes[i]) for t, i in self.added.items()}
        new = list(set().union(*texts).difference(self.cache))
        if not new:
            return
        encoded = [w.encode() for w in new]
        ids, offs = self.rounds(np.frombuffer(b"".join(encoded), np.uint8), np.r_[0, np.cumsum([len(w) for w in encoded])])
        ids, offs, names = ids.tolist(), offs.tolist(), self.bytes
        shown = [str(i) for i in range(len(names))] if not hasattr(self, "shown") else self.shown
        self.shown = shown
        for w, a, b in zip(new, offs, offs[1:], strict=False):
            part = ids[a:b]
            self.cache[w] = ",".join([shown[i] for i in part]), b"".join([names[i] for i in part])

    def forget(self) -> None:
        self.cache = {}

    def cut(self, text: str) -> list[str]:
        if self.split is None or not any(t in text for t in self.added):
            return self.words(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.added else self.words(part))]

    def encode_rows(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by commas, and the bytes that those ids decode to."""
        if not self.cache:
            self.cache = {t: (str(i), self.bytes[i]) for t, i in self.added.items()}
        cut = [self.cut(t) for t in texts]
        self.learn(cut)
        get = self.cache
        for words in cut:
            pairs = [get[w] for w in words]
            yield ",".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])

    def encode(self, text: str) -> list[int]:
        ids = next(self.encode_rows([text]))[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


def _again(state: dict) -> Bpe:
    out = Bpe.__new__(Bpe)
    out.__dict__ |= state | {"words": regex.compile(PATTERN).findall}
    return out


def _run(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    """One scan without a shuffle. The vocabulary is a file of fixed size, sent once to each executor."""
    sent = share(docs.sparkSession, Bpe(path))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in tx.pieces(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows = [row(t, i, b) for t, (i, b) in zip(texts, model.encode_rows(texts), strict=True)]
                cols = [pa.array(list(c), pa.list_(pa.int32()) if n == "ids" else None) for n, c in zip(names[1:], zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], names)
        model.forget()  # the worker may wait long for its next task

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tx.trimmed(run), schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded_sha256 of whole texts, in one pass."""

    def row(text: str, ids: str, back: bytes):
        flat = np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)
        return len(flat), flat, hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest()

    return _run(docs, path, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", row)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""

    def row(text: str, ids: str, back: bytes):
        decoded = back.decode("utf-8", "replace").encode()
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _run(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
