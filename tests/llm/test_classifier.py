"""The additive classifier: features against plain Python, tables against direct sums, held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crashlens.llm.catalog import op11_quality_classifier
from crashlens.llm.classifier import FEATURES, SYMBOLS, Additive, classify, fit_additive, measure, training_rows
from tests.llm import brute
from tests.llm.conftest import CLASHES, DOC_SCHEMA, prose

LABELS = "doc_id long, quality int"


def plain_features(text):
    text = text or ""
    data, words = text.encode(), brute.words(text)
    n = max(1, len(words))
    raw = [w.encode() for w in words]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [brute.words(x) for x in text.split("\n")]
    lines = [x for x in lines if x]
    upper = sum(65 <= b <= 90 for b in data)
    lower = sum(97 <= b <= 122 for b in data)
    counts = Counter(data)
    symbols = [sum(c in SYMBOLS for c in w) for w in words]
    return {
        "words_log": math.log1p(len(words)), "word_bytes": sum(map(len, raw)) / n,
        "longest_log": math.log1p(max(map(len, raw), default=0)), "symbols_per_word": sum(symbols) / n,
        "symbol_words": sum(s > 0 for s in symbols) / n, "upper_letters": upper / max(1, upper + lower),
        "capital_words": sum(65 <= w[0] <= 90 for w in raw) / n, "digit_bytes": sum(48 <= b <= 57 for b in data) / max(1, len(data)),
        "marks_per_word": sum(c in ".,;:!?'\"()-" for c in text) / n, "shouts_per_word": text.count("!") / n,
        "beyond_bytes": sum(b >= 128 for b in data) / max(1, len(data)), "closed_words": sum(w[-1] in ".,;:!?" for w in words) / n,
        "one_byte_words": sum(len(w) == 1 for w in raw) / n,
        "same_as_previous": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "in_repeated_windows": len(inside) / n, "distinct_words": len(set(words)) / n,
        "words_per_line": len(words) / max(1, len(lines)),
        "repeated_lines": (len(lines) - len({tuple(x) for x in lines})) / max(1, len(lines)),
        "closed_lines": sum(x[-1][-1] in ".,;:!?" for x in lines) / max(1, len(lines)),
        "entropy": -sum(c / len(data) * math.log2(c / len(data)) for c in counts.values())}


def test_features_of_every_text(spark, edge_rows):
    texts = [t for _, t in edge_rows]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["a\na\n\n b \nb\n", "A! A! A! B# | x|y\t\n\n", "aa bb cc aa bb cc dd", "…", "\n", "x"]
    got = measure(pa.array(texts, pa.string()))
    want = np.array([[plain_features(t)[f] for f in FEATURES] for t in texts])
    assert np.allclose(got, want, atol=1e-9)


def test_score_is_the_sum_of_table_entries():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit_additive(x, y, cycles=20, n_pairs=3)
    for row, z in zip(x[:50], model.log_odds(x[:50]), strict=True):
        total = model.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        total += sum(t[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])]
                     for (i, j), t in model.pairs.items())
        assert z == pytest.approx(total)


def test_pair_tables_learn_what_no_single_feature_shows():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(float)
    model, alone = fit_additive(x[:2000], y[:2000]), fit_additive(x[:2000], y[:2000], n_pairs=0)
    hit = [((m.score(x[2000:]) > 0.5) == (y[2000:] == 1)).mean() for m in (model, alone)]
    assert (1, 3) in model.pairs and hit[0] > 0.9 and hit[1] < 0.6


def test_one_class_or_no_rows():
    assert fit_additive(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert fit_additive(np.ones((9, 3)), np.ones(9)).score(np.zeros((1, 3)))[0] == pytest.approx(0.95)
    assert isinstance(fit_additive(np.ones((9, 2)), np.arange(9) % 2.0), Additive)  # equal rows, both labels


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op11_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    unseen = [(got[i].score, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert len(unseen) > 50 and auc(unseen) > 0.97
    assert sum((s >= 0.3) == y for s, y in unseen) / len(unseen) > 0.95


def labelled(spark, n=300):
    r = random.Random(4)
    rows = [(i, prose(i, 40) if i % 2 else " ".join(r.choice("# $ & |".split()) for _ in range(40))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], LABELS)


def test_edges_and_clashing_columns(spark, edge_rows):
    docs, labels = labelled(spark)
    more = spark.createDataFrame(edge_rows, "doc_id long, text string")
    docs = docs.union(more).withColumns({c: F.lit("x") for c in (*CLASHES, "_id", "_x", "_score", "score", "quality", "_target")})
    odd = [(None, 1), (1, None), (5, 1), (5, 1), (10 ** 9, 0)]
    labels = labels.union(spark.createDataFrame(odd, LABELS)).withColumns({c: F.lit("x") for c in ("text", "score", "_x", "lang")})
    rows = classify(docs, labels).collect()
    assert len(rows) == 300 + len(edge_rows)
    scores = {}
    for r in rows:
        key = r.row.text if r.row.text and r.row.text.strip() else ""
        assert scores.setdefault(key, r.q.score) == r.q.score  # equal texts, equal scores; null is empty
        assert r.row.q == "x" and r.q.held_out == (r.row.doc_id is not None and zlib.crc32(str(r.row.doc_id).encode()) % 5 == 0)
    assert all((r.q.predicted == 1) == (r.row.doc_id % 2 == 1) for r in rows if r.row.doc_id is not None and r.row.doc_id > 20)


def test_training_never_sees_the_held_out_fold_and_is_bounded(spark):
    docs, labels = labelled(spark)
    x, y = training_rows(docs, labels)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)) and x.shape[1] == len(FEATURES)
    assert len(training_rows(docs, labels, sample_rows=20)[1]) == 20
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                                  1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (sorted((r.row.doc_id, r.q.score) for r in classify(docs, k).collect()) for k in (labels, flipped))
    assert first == second


def test_empty_tables(spark):
    docs, labels = labelled(spark, 20)
    assert classify(docs.limit(0), labels).count() == 0
    assert {r.q.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(spark.createDataFrame([], DOC_SCHEMA), labels.limit(0)).count() == 0
