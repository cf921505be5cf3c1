"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Two tokenizers cut the same bytes.  An interval that both cut alike at its ends is searched by
bisect for the common ends nearest to its middle, one on either side; the stretch between them
holds no common end and becomes a leaf group, the two remaining parts are searched in turn.
All intervals of a slice of documents are searched at once, level by level.

Links of token ids are counted over the corpus: each block of documents sends its distinct
id pairs once, and gets back the counts of exactly these.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.scratch import Scratch
from crashlens.llm.tokens import byte_characters
from crashlens.llm.words import record, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Places of an id pair's A id in a long: pair = a << PAIR_BITS | b.
PAIR_BITS = 24
#: Links of one group that are listed singly; larger groups first count their equal ids.
LISTED_LINKS = 4096
#: Characters beyond Latin letters.
_WIDE = re.compile("[\u0240-\U0010ffff]")
#: Fixed value: the public pre-tokenizer pattern of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


# -- tokenizers ---------------------------------------------------------------------------

class ByteTokenizer:
    """Byte-level BPE from a vocabulary file's text; ``pieces[id]`` are an id's bytes.

    Merging by the ranks of the file's vocabulary gives the same ids faster, provided that ids rise
    in merge order and the file has the plain form; texts with characters beyond Latin letters, where Unicode
    tables of the two libraries might differ, and files of another form use the file's own tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(file)
        self.own.encode_special_tokens = True
        self.shown: list[str] = []
        spec = json.loads(file)
        shown = byte_characters()
        vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if all(c in shown for c in t)}
        self.pieces = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(shown[c] for c in token)
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {self.pieces[i]: i for i in vocabulary.values() if i not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"]["".join(m)] for m in merges]
        before = spec["pre_tokenizer"] or {}
        plain = (spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex")
                 and not before.get("add_prefix_space") and not spec["model"].get("ignore_merges")
                 and len(ranks) == 256 + len(merges) and all(x < y for x, y in pairwise(made)))
        self.fast = None
        if plain:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.own.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) if _WIDE.search(t) is None
                else self.own.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokenizer:
    """Sentence pieces from a model file's bytes; ``pieces[id]`` are an id's bytes."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.pieces = []
        for i in range(self.own.get_piece_size()):
            piece = self.own.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:-1], 16)]) if self.own.is_byte(i)
                               else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


# -- shared cuts --------------------------------------------------------------------------

def _next_common(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the least value from x on that both sorted arrays hold (each must end in a common one)."""
    out, open_ = np.empty_like(x), np.arange(len(x))
    while len(open_):
        va = a[np.searchsorted(a, x)]
        vb = b[np.searchsorted(b, va)]
        hit = va == vb
        out[open_[hit]] = va[hit]
        open_, x = open_[~hit], vb[~hit]
    return out


def _last_common(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the greatest value up to x that both hold (each must start with a common one)."""
    out, open_ = np.empty_like(x), np.arange(len(x))
    while len(open_):
        va = a[np.searchsorted(a, x, "right") - 1]
        vb = b[np.searchsorted(b, va, "right") - 1]
        hit = va == vb
        out[open_[hit]] = va[hit]
        open_, x = open_[~hit], vb[~hit]
    return out


def shared_cuts(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ascending ends of the leaf groups: all values above 0 that ``a`` and ``b`` share.

    ``a`` and ``b`` are ascending token ends, a leading 0 included; ``ends`` (common to both) cut them
    into the first intervals.  Each search parts an interval at the common ends around its middle, so
    the parts are at most half as long, and what lies between is a leaf group.
    """
    lo, hi = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)
    lo, hi = lo[lo < hi], hi[lo < hi]
    found = []
    while len(lo):
        middle = (lo + hi) // 2 + 1  # above lo, up to hi
        right = _next_common(a, b, middle)
        left = _last_common(a, b, middle - 1)
        found.append(right)  # the leaf group is (left, right]
        lo, hi = np.stack([lo, right], 1).ravel(), np.stack([left, hi], 1).ravel()  # still ascending
        some = lo < hi
        lo, hi = lo[some], hi[some]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


class Aligned:
    """Groups of a slice of documents.

    ``a``, ``b``: token ids of all documents in turn; ``a_off``, ``b_off``: where a document's begin;
    ``ga``, ``gb``: each group's first token (one entry more than groups); ``g_off``: where a document's groups begin.
    """

    def __init__(self, texts: list[str | None], one: ByteTokenizer, two: PieceTokenizer):
        self.width = max(len(one.pieces), len(two.pieces))
        if len(one.shown) != 3 * self.width:  # every id with each of the marks that may follow it, made once a worker
            one.shown = [f"{i}{c}" for c in ",|;" for i in range(self.width)]
        self.shown = one.shown
        a, b = self._tokens(texts, one, two)
        self.a, self.a_off = _flat(a)
        self.b, self.b_off = _flat(b)
        a_end = np.concatenate([[0], np.cumsum(np.array([len(p) for p in one.pieces], np.int64)[self.a])])
        b_end = np.concatenate([[0], np.cumsum(np.array([len(p) for p in two.pieces], np.int64)[self.b])])
        cuts = shared_cuts(a_end, b_end, a_end[self.a_off[1:]])
        self.ga = np.concatenate([[0], np.searchsorted(a_end, cuts)])
        self.gb = np.concatenate([[0], np.searchsorted(b_end, cuts)])
        self.g_off = np.searchsorted(self.ga, self.a_off)

    @staticmethod
    def _tokens(texts, one, two):
        """Ids of both tokenizers; none for a text whose pieces do not spell it."""
        chosen = [i for i, t in enumerate(texts) if t]
        a, b = [[] for _ in texts], [[] for _ in texts]
        spaced = [" " + texts[i] for i in chosen]
        found = zip(chosen, spaced, one.encode(spaced), two.encode([texts[i] for i in chosen]), strict=True)
        for i, text, x, y in found:
            whole = text.encode()
            if b"".join(map(one.pieces.__getitem__, x)) == whole == b"".join(map(two.pieces.__getitem__, y)):
                a[i], b[i] = x, y
        return a, b

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, how often) of all links: every A token with every B token of its group."""
        m, n = np.diff(self.ga), np.diff(self.gb)
        doc = np.repeat(np.arange(len(self.g_off) - 1), np.diff(self.g_off))
        large = np.flatnonzero(m * n > LISTED_LINKS)
        few = np.where(m * n > LISTED_LINKS, 0, m)
        token = _ranges(self.ga[:-1], few)
        group = np.repeat(np.arange(len(m)), few)
        b = self.b[_ranges(self.gb[group], n[group])]
        pair = np.repeat(self.a[token], n[group]) << PAIR_BITS | b
        docs, pairs, times = [np.repeat(doc[group], n[group])], [pair], [np.ones(len(pair), np.int64)]
        for g in large.tolist():
            x, k = np.unique(self.a[self.ga[g]:self.ga[g + 1]], return_counts=True)
            y, l = np.unique(self.b[self.gb[g]:self.gb[g + 1]], return_counts=True)
            pairs.append((x[:, None] << PAIR_BITS | y).ravel())
            times.append((k[:, None] * l).ravel())
            docs.append(np.full(len(x) * len(y), doc[g]))
        return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)

    def counts(self) -> dict[str, np.ndarray]:
        """Per document: numbers of tokens, groups and links."""
        per_group = np.concatenate([[0], np.cumsum(np.diff(self.ga) * np.diff(self.gb))])
        return dict(zip(_COUNTS, (np.diff(self.a_off), np.diff(self.b_off), np.diff(self.g_off),
                                  np.diff(per_group[self.g_off])), strict=True))

    def spelled(self) -> Iterator[str]:
        """Per document its groups as ``a1,a2|b1;a3|b2,b3``."""
        width = self.width
        shown = self.shown
        # an A token moves behind the B tokens of earlier groups, a B token behind the A tokens up to its group's
        m, n = np.diff(self.ga), np.diff(self.gb)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        a_mark, b_mark = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_mark[self.ga[1:] - 1], b_mark[self.gb[1:] - 1] = 1, 2
        code[np.arange(len(self.a)) + np.repeat(self.gb[:-1], m)] = self.a + a_mark * width
        code[np.arange(len(self.b)) + np.repeat(self.ga[1:], n)] = self.b + b_mark * width
        code = code.tolist()
        for lo, hi in pairwise((self.a_off + self.b_off).tolist()):
            yield "".join(map(shown.__getitem__, code[lo:hi]))[:-1]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
    return np.fromiter(chain.from_iterable(lists), np.int64, off[-1]), off


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), then the same from start[1] on, and so on."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - before, count)


# -- Spark --------------------------------------------------------------------------------

def _files(spark: SparkSession, byte_bpe: str, piece_bpe: str):
    """Broadcast of both vocabulary files' contents (plain data, bounded by the files)."""
    with open(byte_bpe, encoding="utf-8") as f:
        first = f.read()
    with open(piece_bpe, "rb") as f:
        second = f.read()
    return spark.sparkContext.broadcast({"a": first, "b": second})


def _tokenizers(shared: dict) -> tuple[ByteTokenizer, PieceTokenizer]:
    """Both tokenizers, built once a Python worker."""
    if "built" not in shared:
        shared["built"] = ByteTokenizer(shared["a"]), PieceTokenizer(shared["b"])
    return shared["built"]


def aligned_groups(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``groups``: an array of (a, b), the token ids of both
    tokenizers in each aligned group, in text order.

    Null and empty texts, and those whose pieces do not spell space + text, have no groups.
    """
    shared = _files(docs.sparkSession, byte_bpe, piece_bpe)
    ids = T.ArrayType(T.IntegerType())

    @F.arrow_udf(T.ArrayType(record(a=ids, b=ids)))
    def groups(texts: pa.Array) -> pa.Array:
        parts = []
        for lo, hi in slices(texts):
            x = Aligned(texts.slice(lo, hi - lo).to_pylist(), *_tokenizers(shared.value))
            sides = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32)))
                     for o, v in ((x.ga, x.a), (x.gb, x.b))]
            parts.append(pa.ListArray.from_arrays(pa.array(x.g_off.astype(np.int32)), pa.StructArray.from_arrays(sides, ["a", "b"])))
        return pa.concat_arrays(parts)

    return docs.select(F.struct("*").alias("row"), groups(F.col(text_col)).alias("groups"))


_BLOCK = record(block=T.LongType(), ids=T.ArrayType(T.LongType()), **{c: T.ArrayType(T.LongType()) for c in _COUNTS},
                groups_sha256=T.ArrayType(T.StringType()), links=T.ArrayType(T.IntegerType()), which=T.BinaryType(),
                times=T.BinaryType(), pairs=T.ArrayType(T.LongType()), held=T.ArrayType(T.LongType()))


def _pack(values: np.ndarray) -> bytes:
    """Compressed 32-bit integers behind their number."""
    raw = values.astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd"), np.int32)


def _blocks(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow: a slice of documents (id, text) becomes one row.

    ``links[d]`` distinct id pairs of document d follow each other in ``which`` (places in ``pairs``, as
    differences) and ``times``; ``held`` is the number of the block's documents that hold each pair.
    """
    schema = _arrow(_BLOCK)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                if hi == lo:
                    continue
                x = Aligned(texts.slice(lo, hi - lo).to_pylist(), *_tokenizers(shared.value))
                doc, pair, times = x.links()
                pairs, place = np.unique(pair, return_inverse=True)
                key, at = np.unique(doc * max(1, len(pairs)) + place, return_inverse=True)
                doc, place = np.divmod(key, max(1, len(pairs)))
                counts = x.counts()
                yield pa.RecordBatch.from_pylist([{
                    "block": number, "ids": ids.slice(lo, hi - lo).to_pylist(), **counts,
                    "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.spelled()],
                    "links": np.bincount(doc, minlength=hi - lo), "which": _pack(np.diff(place, prepend=0)),
                    "times": _pack(np.bincount(at, times, len(key))), "pairs": pairs,
                    "held": np.bincount(place, minlength=len(pairs))}], schema=schema)
                number += 1
    return run


_RESULT = record(id=T.LongType(), **{c: T.LongType() for c in _COUNTS}, n_best=T.LongType(), count_sum=T.LongType(),
                 groups_sha256=T.StringType())


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: blocks with the counts of their pairs become rows of documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            which, times = np.cumsum(_unpack(row["which"].as_py()), dtype=np.int64), _unpack(row["times"].as_py())
            known = row["known"].values if row["known"].is_valid else None  # null: a block without links
            count = _numbers(known.field("count")) if known is not None else np.empty(0, np.int64)
            best = _numbers(known.field("best")) if known is not None else np.empty(0, np.int64)
            off = np.concatenate([[0], np.cumsum(_numbers(row["links"].values))])

            def sums(weights, off=off, times=times):
                return np.diff(np.concatenate([[0], np.cumsum(weights * times)])[off])

            yield pa.RecordBatch.from_arrays(
                [row["ids"].values, *[row[c].values for c in _COUNTS], pa.array(sums(best[which])),
                 pa.array(sums(count[which])), row["groups_sha256"].values], schema=_arrow(_RESULT))


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    return pa.schema([(f.name, pa.list_(kinds[f.dataType.elementType]) if isinstance(f.dataType, T.ArrayType)
                       else kinds[f.dataType]) for f in schema])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents corpus-wide that hold an id pair linked, and whether (1 or 0) no pair of the
    same A id has more."""
    counts = blocks.groupBy("pair").agg(F.sum("held").alias("count"))
    best = counts.groupBy(F.shiftright("pair", PAIR_BITS).alias("_a")).agg(F.max("count").alias("_most"))
    return counts.join(best, F.shiftright("pair", PAIR_BITS) == F.col("_a")).select(
        "pair", "count", (F.col("count") == F.col("_most")).cast("long").alias("best"))


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, numbers of A and B tokens, groups and links, n_best (links whose id pair
    no other pair of the same A id exceeds in documents), count_sum (documents of the link's pair, summed over
    links) and groups_sha256.

    Null and empty texts, and those whose joined token bytes differ from space + text in either tokenizer,
    have zeros and ''.  Repeated rows and ids count as documents of their own; a null id stays null.  Texts of
    any length are aligned whole; a long one is a block by itself.  Other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "align")
    shared = _files(docs.sparkSession, byte_bpe, piece_bpe)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = scratch.save(rows.mapInArrow(_blocks(shared), _BLOCK), "blocks")
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("block", "p.pairs", "p.held")
    pairs = pairs.withColumnRenamed("pairs", "pair")
    known = scratch.save(pair_counts(pairs), "known")
    sent = pairs.select("block", "pair").join(known, "pair").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("pair", "count", "best"))).alias("known"))
    met = blocks.drop("pairs", "held").join(sent, "block", "left")
    return met.mapInArrow(_scored, _RESULT).withColumnRenamed("id", id_col)
