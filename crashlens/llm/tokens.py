"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces of a word are counted in one pass: the vocabulary is a
trie; when a state has no arc for the next symbol, its failure link leads to the state
that remains after the pieces that are then certain have been cut off, and a precomputed
count says how many they are.  No piece is ever built.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.words import Words, record, slices

END = 256  # symbol after a word's last byte
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CACHE_WORDS = 500_000


def byte_characters() -> dict[str, int]:
    """Characters by which public byte-level vocabularies show bytes: printable ones stand for
    themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY, end: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces as symbols: bytes, then ``END`` if the piece ends a word.  Special tokens are left out."""
    shown = byte_characters()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = []
    for token in vocabulary:
        bare = token.removesuffix(end)
        if bare and all(c in shown for c in bare) and not token.startswith("<|"):
            pieces.append(tuple(shown[c] for c in bare) + (END,) * (bare != token))
    return pieces


class Automaton:
    """Arcs (state * 257 + symbol -> state), failure links (-1: none) and popped-piece counts."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        arcs: dict[int, int] = {}
        parent, by, final = [0], [0], [False]
        for piece in pieces:
            v = 0
            for c in piece:
                k = v * 257 + c
                if k not in arcs:
                    arcs[k] = len(parent)
                    parent.append(v)
                    by.append(c)
                    final.append(False)
                v = arcs[k]
            final[v] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # a parent comes before its children
            depth[v] = depth[parent[v]] + 1
        link, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            z, n = link[parent[v]], popped[parent[v]]
            while z >= 0 and z * 257 + by[v] not in arcs:
                n += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = arcs[z * 257 + by[v]], n
        self.arcs, self.link, self.popped = arcs, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 if the vocabulary cannot spell it."""
        arcs, link, popped = self.arcs, self.link, self.popped
        v = n = 0
        for c in (*word, END):
            while (nxt := arcs.get(v * 257 + c)) is None:
                n += popped[v]
                v = link[v]
                if v < 0:
                    return 1
            v = nxt
        while v:
            n += popped[v]
            v = link[v]
            if v < 0:
                return 1
        return n


def counter(spark: SparkSession, pieces: list[tuple[int, ...]]):
    """UDF text -> (words, tokens).  The automaton, bounded by the vocabulary, is broadcast."""
    shared = spark.sparkContext.broadcast(vars(Automaton(pieces)))  # plain data: workers need not know the class
    cache: dict[int, int] = {}

    @F.arrow_udf(record(n_words=T.LongType(), n_tokens=T.LongType()))
    def count(texts: pa.Array) -> pa.Array:
        automaton, parts = Automaton.__new__(Automaton), []
        vars(automaton).update(shared.value)
        for lo, hi in slices(texts):
            w = Words(texts.slice(lo, hi - lo), lower=True)
            data = w.data.tobytes()
            distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(cache) > CACHE_WORDS:
                cache.clear()
            lengths = np.empty(len(distinct), np.int64)
            for i, (h, s, e) in enumerate(zip(distinct.tolist(), w.start[first].tolist(), w.end[first].tolist(), strict=True)):
                n = cache.get(h)
                if n is None:
                    n = cache[h] = automaton.count(data[s:e])
                lengths[i] = n
            sums = np.concatenate([[0], np.cumsum(lengths[which])])
            parts.append(pa.StructArray.from_arrays(
                [pa.array(w.count.astype(np.int64)), pa.array(sums[w.offset[1:]] - sums[w.offset[:-1]])],
                ["n_words", "n_tokens"]))
        return pa.concat_arrays(parts)

    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``k``: n_words and n_tokens of the text, A-Z
    lower-cased.

    Null, empty and blank texts have none.  A word that the vocabulary cannot spell is one
    token.  Repeated rows are counted alike.  Empty table: no rows.  Extra columns of any name
    stay in ``row``.
    """
    count = counter(docs.sparkSession, read_vocabulary(vocabulary))
    text: Column = F.col(text_col)
    return docs.select(F.struct("*").alias("row"), count(text).alias("k"))
