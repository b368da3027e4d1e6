"""Exact byte-pair encoding by dynamic programming over prefixes.

For a byte-pair vocabulary whose ids are its merge order, the encoding of every prefix of a text ends in one token
only: the one token t matching a suffix of the prefix such that the encoding of what precedes it ends in a token u
for which (u, t) stays two tokens when encoded together. One pass with an automaton over the vocabulary yields the
suffix matches, a pair test settles u and t, and back-pointers give the ids. The work is linear in the text times the
number of matches, whatever the text looks like; no merge loop is run.

Texts are cut into pieces by the vocabulary's own pattern first; a piece's ids are kept per worker in a table of
bounded size, which changes the speed only. No shuffle takes place, unless the input has fewer splits than cores. The vocabulary (a fixed 50 256 entries) is read on
the driver and broadcast.

Defined results: null and empty texts give an empty list; a special token's spelling is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts texts into pieces for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES, PAIRS = 200_000, 1_000_000


def load(path: str = VOCABULARY) -> list[bytes]:
    """The tokens in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def halves(tokens: list[bytes]) -> list[tuple[int, int]]:
    """Of each token the two tokens it was merged from; a single byte is its own halves.

    A token's bytes, encoded with the older tokens only, end up as the two parts whose merge made it.
    """
    rank = {t: i for i, t in enumerate(tokens)}
    out = []
    for i, t in enumerate(tokens):
        if len(t) == 1:
            out.append((i, i))
            continue
        parts = [rank[t[k : k + 1]] for k in range(len(t))]
        while len(parts) > 2:
            joins = [rank.get(tokens[a] + tokens[b], i) for a, b in zip(parts, parts[1:])]
            k = min(range(len(joins)), key=joins.__getitem__)
            if joins[k] >= i:
                raise ValueError(f"token {i} is not made of two older ones")
            parts[k : k + 2] = [joins[k]]
        out.append((parts[0], parts[1]))
    return out


class Encoder:
    def __init__(self, tokens: list[bytes], parts: list[tuple[int, int]]) -> None:
        self.tokens, self.parts = tokens, parts
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.merged = {p: i for i, p in enumerate(parts) if p[0] != i}
        self.suffixes = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.suffixes.add_word(t.decode("latin-1"), (i, len(t)))
        self.suffixes.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def _stays_apart(self, u: int, t: int) -> bool:
        """Whether no merge across the border of u and t would have come before those that made u and t.

        Both tokens are unwound merge by merge, newest first; at each stage the two that face each other at the
        border must not be a pair that merges earlier than the next merge to be unwound.
        """
        bound = len(self.tokens)
        while True:
            joined = self.merged.get((u, t))
            if joined is not None and joined < bound:
                return False
            if u > t and self.parts[u][0] != u:  # the newer of the two was made last
                bound, u = u, self.parts[u][1]
            elif self.parts[t][0] != t:  # of equal tokens the right one was
                bound, t = t + 1, self.parts[t][0]
            else:
                return True

    def piece(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        one = self.whole.get(data)
        if one is not None:
            return [one]
        n = len(data)
        last, size, done = [-1] * (n + 1), [0] * (n + 1), 0
        for end, (t, k) in self.suffixes.iter(data.decode("latin-1")):
            end += 1
            if end == done:
                continue
            u = last[end - k]
            if end > k:
                key = (u, t)
                ok = self.apart.get(key)
                if ok is None:
                    if len(self.apart) >= PAIRS:
                        self.apart.clear()
                    ok = self.apart[key] = self._stays_apart(u, t)
                if not ok:
                    continue
            last[end], size[end], done = t, k, end
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for p in self.split(text) if text else ():
            got = known.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) <= 64:
                    if len(known) >= PIECES:
                        known.clear()
                    known[p] = got
            ids += got
        return ids


_ENCODERS: dict[str, Encoder] = {}
_TABLES: dict[str, tuple] = {}


def tables(path: str = VOCABULARY) -> tuple[list[bytes], list[tuple[int, int]]]:
    if path not in _TABLES:
        tokens = load(path)
        _TABLES[path] = (tokens, halves(tokens))
    return _TABLES[path]


def encode_column(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of the ids of text."""
    shared = spark.sparkContext.broadcast(tables(path))

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _ENCODERS.get(path)
        if enc is None:
            enc = _ENCODERS[path] = Encoder(*shared.value)
        for t in texts:
            yield pd.Series([enc.encode(x) for x in t], dtype=object)

    return run(text)


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids."""
    documents = spread(documents.select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", encode_column(documents.sparkSession, F.col("text"), path).alias("ids"))
