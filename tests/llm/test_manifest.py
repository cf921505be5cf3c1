"""The Merkle manifest against a plain Python tree."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crashlens.llm.catalog import op13_merkle_manifest
from crashlens.llm.manifest import fold, manifest, path_digest, tampered
from tests.llm.conftest import CLASHES, DOC_SCHEMA
from tests.oracle_check import compare, duck

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof", "folded"]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, arity):
    """Root of the nodes and each one's path of (before, after)."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k:k + arity]
            for j in range(len(run)):
                for x in own[k + j]:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(H("".join(run)))
            owners.append(sum(own[k:k + arity], []))
        nodes, own = above, owners
    return nodes[0], paths


def brute(rows, arity=2):
    leaves = [leaf_of(*r) for r in rows]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[2]].append(i)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroot, path = {}, {}
    for name in names:
        order = sorted(groups[name], key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        subroot[name], found = tree([leaves[i] for i in order], arity)
        path |= dict(zip(order, found, strict=True))
    root, upper = tree([subroot[n] for n in names], arity) if names else (None, [])
    out = []
    for i, (doc_id, text, lang, source, n) in enumerate(rows):
        whole = path[i] + upper[names.index(lang)]
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        h = leaf_of(doc_id, text, lang, source, n + 1) if hit else leaves[i]
        for a, b in whole:
            h = H(a + h + b)
        out.append((doc_id, leaves[i], subroot[lang], root, H("".join(a + b for a, b in whole)), h))
    return sorted(out, key=str)


def run(df, **options):
    out = manifest(df, tamper=tampered(), **options)
    got = out.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")), fold(F.col("claimed"), F.col("path")))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, one-leaf and odd-sized groups."""
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None,) * 5, (None, "x", None, "s", 3), (2, "", None, "s", 3),
            (3, "é", "ß", "s", 2), (4, "x", "zz", "s", None), (7, "q", "en", None, 5), (7, "r", "en", None, 5),
            (8, "long " * 40_000, "EN", "s", 200_000)]
    return rows + [(i, "t" * i, "fr", "s", i) for i in range(45)]


@pytest.mark.parametrize("block_digits", [1, 3, 10])
def test_edges_in_blocks_of_any_size(spark, odd_rows, block_digits):
    df = spark.createDataFrame(odd_rows, DOC_SCHEMA)
    assert run(df, block_digits=block_digits) == brute(odd_rows)


def test_other_arity_and_clashing_columns(spark, odd_rows):
    names = (*CLASHES, "group", "_id", "_row", "_leaf", "index", "levels", "block", "path", "d0")
    df = spark.createDataFrame(odd_rows, DOC_SCHEMA).withColumns({c: F.lit("x") for c in names})
    assert run(df, arity=3, block_digits=2) == brute(odd_rows, arity=3)


def test_one_leaf_and_empty_table(spark):
    one = [(5, "only", "en", "s", 4)]
    df = spark.createDataFrame(one, DOC_SCHEMA)
    assert run(df) == brute(one)
    assert manifest(df).first()["subroot"] == leaf_of(*one[0])
    assert run(df.limit(0)) == []


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    from crashlens.llm.catalog import oracle_sql

    got = op13_merkle_manifest(spark, sf).toPandas()
    assert compare(got, duck(sf).execute(oracle_sql()["op13_merkle_manifest"]).df())["exact"]
    assert 0 < (~got.verified).sum() < len(got) / 4


def test_any_change_is_found(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(9)]
    roots = {manifest(spark.createDataFrame(x, DOC_SCHEMA)).first()["root"] for x in (
        rows, rows[:-1], rows[::-1], [*rows[:-1], (8, "text 8", "en", "s", 9)], [*rows[:-1], (8, "text 8", "fr", "s", 8)])}
    assert len(roots) == 4  # the order in which rows are stored does not matter
