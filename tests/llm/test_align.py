"""Cross-tokenizer alignment against plain Python over the two tokenizers themselves."""

from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crashlens.llm import align as module
from crashlens.llm.align import BYTE_BPE, PIECE_BPE, ByteTokenizer, align, aligned_groups, shared_cuts
from crashlens.llm.catalog import op12_tokenizer_alignment
from crashlens.llm.tokens import byte_characters
from tests.llm.conftest import DOC_SCHEMA

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    one = Tokenizer.from_file(BYTE_BPE)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def brute_groups(text, one, two):
    """[(A ids, B ids)] of a text."""
    if not text:
        return []
    shown = byte_characters()
    e, y = one.encode(" " + text, add_special_tokens=False), two.encode(text)
    a = [bytes(shown[c] for c in t) for t in e.tokens]
    b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(a) == b"".join(b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(p) for p in side]).tolist() for side in (a, b)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for side, ids in enumerate((e.ids, y)):
        for i, end in zip(ids, ends[side], strict=True):
            groups[bisect.bisect_left(cuts, end)][side].append(i)
    return groups


def brute(rows, one, two):
    docs = [(i, brute_groups(t, one, two)) for i, t in rows]
    held = Counter(p for _, g in docs for p in {(a, b) for x, y in g for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for i, g in docs:
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=str)


def test_whole_table(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(op12_tokenizer_alignment(spark, sf)) == brute(rows, *tokenizers)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    strange = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x4E00, 0x9000),
                                    r.randrange(0x1F300, 0x1F600)])) for _ in range(3000))
    return [(1, None), (2, ""), (3, " "), (4, " \n\t\r\n  "), (5, "a▁b"), (6, "<|endoftext|> <s> </s> <unk> <0x0A>"), (7, strange),
            (8, "日本語のテキスト" * 300), (9, "x" * 20_000), (10, "the cat " * 9000), (11, "same"), (11, "same"), (None, "same"),
            (None, None), (12, "é ​  naïve ﬁne ½ \x00\x01\x85"), (13, "don't they've 12345 ... --- ###\n\n\n  end  ")]


def test_odd_texts_and_clashing_columns(spark, odd_rows, tokenizers):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("id", "block", "pair", "pairs", "held", "known", "count", "n_a", "row")})
    assert rows_of(align(df)) == brute(odd_rows, *tokenizers)


def test_groups_in_text_order(spark, odd_rows, tokenizers):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("groups", F.lit("x"))
    for r in aligned_groups(df).collect():
        assert [(list(g.a), list(g.b)) for g in r.groups] == brute_groups(r.row.text, *tokenizers)
        assert r.row.groups == "x"


def test_large_groups_are_counted_alike(odd_rows, monkeypatch):
    one, two = ByteTokenizer(open(BYTE_BPE, encoding="utf-8").read()), module.PieceTokenizer(open(PIECE_BPE, "rb").read())
    x = module.Aligned([t for _, t in odd_rows], one, two)

    def totals():
        out = Counter()
        for d, p, n in zip(*x.links(), strict=True):
            out[int(d), int(p)] += int(n)
        return out

    listed = totals()
    monkeypatch.setattr(module, "LISTED_LINKS", 1)
    assert totals() == listed and sum(listed.values()) == x.counts()["n_links"].sum()


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC_SCHEMA)
    assert rows_of(align(df)) == [] and aligned_groups(df).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_all_common_ends(seed):
    r = random.Random(seed)
    size = r.randrange(1, 400)
    docs = sorted(r.sample(range(1, size + 1), r.randrange(0, min(size, 4)))) + [size]
    a, b = ({0, *docs, *r.sample(range(1, size + 1), r.randrange(0, size))} for _ in range(2))
    ends = np.array([0, *docs, size])  # documents of no bytes at either end
    got = shared_cuts(np.array(sorted(a)), np.array(sorted(b)), ends)
    assert got.tolist() == sorted((a & b) - {0})


def test_fast_ids_equal_the_file_tokenizer(tokenizers):
    fast = ByteTokenizer(open(BYTE_BPE, encoding="utf-8").read())
    assert fast.fast is not None
    r = random.Random(9)
    syllables = "the ing er an on ti  \n st en!! 'll 've 12 é ñ ß , . ## ion Th A B".split(" ")
    texts = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.randrange(1, 0x240)) for _ in range(40)) for _ in range(3000)]
    assert fast.encode(texts) == [e.ids for e in tokenizers[0].encode_batch(texts, add_special_tokens=False)]
