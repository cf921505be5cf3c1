"""Quality classifier: generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time, then on a few pairs of features; each
tree only adds to its feature's lookup table over bins, so that the finished model is one
table a feature or pair, and a score is a sum of table entries.  The model is fitted on a bounded
sample of labelled rows and applied to whole texts where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.words import Words, lists, slices

SYMBOLS = "#*$%&|<>"
#: What is measured of a text; shares are of its words, letters, bytes or lines.
FEATURES = ("words_log", "word_bytes", "longest_log", "symbols_per_word", "symbol_words", "upper_letters", "capital_words",
            "digit_bytes", "marks_per_word", "shouts_per_word", "beyond_bytes", "closed_words", "one_byte_words",
            "same_as_previous", "in_repeated_windows", "distinct_words", "words_per_line", "repeated_lines", "closed_lines",
            "entropy")
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3


def _kind(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) if isinstance(c, str) else c for c in members]] = True
    return table


_SYMBOL, _MARK, _CLOSE, _SHOUT = _kind(SYMBOLS), _kind(".,;:!?'\"()-"), _kind(".,;:!?"), _kind("!")
_UPPER, _LOWER, _DIGIT, _BEYOND = _kind(range(65, 91)), _kind(range(97, 123)), _kind(range(48, 58)), _kind(range(0x80, 256))
_LINE = _kind("\n")


# -- features -----------------------------------------------------------------------------

def measure(texts: pa.Array) -> np.ndarray:
    """Rows of ``FEATURES`` of whole texts; null texts count as empty, and a share of nothing is 0."""
    parts = [_measure(Words(texts.slice(lo, hi - lo))) for lo, hi in slices(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(FEATURES)))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _measure(w: Words) -> np.ndarray:
    n = w.count.astype(np.float64)
    size = np.diff(w.row).astype(np.float64)

    def bytes_of(kind):
        return np.diff(np.concatenate([[0], np.cumsum(kind[w.data])])[w.row]).astype(np.float64)

    def words_of(flag):
        return np.bincount(w.doc, flag, len(n))

    length = w.end - w.start
    longest = np.zeros(len(n))
    np.maximum.at(longest, w.doc, length)
    symbol_at = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    first, last = w.data[w.start], w.data[w.end - 1]
    same = np.zeros(len(w.doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    upper, letters = bytes_of(_UPPER), bytes_of(_UPPER) + bytes_of(_LOWER)
    n_lines, repeated, closed = _lines(w, last)
    columns = {
        "words_log": np.log1p(n), "word_bytes": _share(words_of(length), n), "longest_log": np.log1p(longest),
        "symbols_per_word": _share(bytes_of(_SYMBOL), n),
        "symbol_words": _share(words_of(symbol_at[w.end] > symbol_at[w.start]), n),
        "upper_letters": _share(upper, letters), "capital_words": _share(words_of(_UPPER[first]), n),
        "digit_bytes": _share(bytes_of(_DIGIT), size), "marks_per_word": _share(bytes_of(_MARK), n),
        "shouts_per_word": _share(bytes_of(_SHOUT), n), "beyond_bytes": _share(bytes_of(_BEYOND), size),
        "closed_words": _share(words_of(_CLOSE[last]), n), "one_byte_words": _share(words_of(length == 1), n),
        "same_as_previous": _share(words_of(same), n), "in_repeated_windows": _share(words_of(_in_repeats(w)), n),
        "distinct_words": _share(np.bincount(w.doc[order], new, len(n)), n), "words_per_line": _share(n, n_lines),
        "repeated_lines": _share(repeated, n_lines), "closed_lines": _share(closed, n_lines), "entropy": _entropy(w, len(n))}
    return np.column_stack([columns[c] for c in FEATURES])


def _in_repeats(w: Words, k: int = 3) -> np.ndarray:
    """Words inside k-word windows that their text holds more than once."""
    found, whole = w.windows(k)
    at = np.flatnonzero(whole)
    order = at[np.lexsort((found[at], w.doc[at]))]
    equal = (found[order][1:] == found[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    depth = np.zeros(len(w.doc) + 1, np.int64)
    hit = np.zeros(len(w.doc), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    starts = np.flatnonzero(hit)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + k, -1)
    return np.cumsum(depth[:-1]) > 0


def _lines(w: Words, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word of each text: how many, how many equal an earlier one by their words, how many end closed."""
    n = len(w.count)
    if not len(w.start):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    breaks = np.concatenate([[0], np.cumsum(_LINE[w.data])])
    line = breaks[w.start]
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    begin = np.flatnonzero(first)
    stop = np.concatenate([begin[1:], [len(line)]])
    place = np.arange(len(line)) - np.repeat(begin, stop - begin)
    mixed = w.hash * (2 * place.astype(np.uint64) + np.uint64(1)) + place.astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    key, doc = total[stop] - total[begin], w.doc[begin]
    order = np.lexsort((key, doc))
    again = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return (np.bincount(doc, minlength=n).astype(np.float64), np.bincount(doc[order][1:], again, n),
            np.bincount(doc, _CLOSE[last[stop - 1]], n))


def _entropy(w: Words, n: int) -> np.ndarray:
    """Bits a byte of each text's byte histogram."""
    row = np.repeat(np.arange(n), np.diff(w.row))
    key, count = np.unique(row * 256 + w.data, return_counts=True)
    size = np.maximum(np.diff(w.row), 1)[key // 256]
    return np.bincount(key // 256, -count / size * np.log2(count / size), n)


# -- model --------------------------------------------------------------------------------

@dataclass
class Additive:
    """Lookup tables of a fitted model.

    ``edges[f]`` part feature f into bins (a value equal to an edge lies above it), ``tables[f]`` hold what
    a bin adds to the log-odds; ``coarse`` and ``pairs`` do so for pairs of features.
    """

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantile edges between distinct values, so that every bin holds sample values."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram along its last axis: bins below the place go left."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), _gain(gl, hl, ridge) + _gain(gr, hr, ridge) - _gain(g.sum(), h.sum(), ridge), 0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, depth: int = 2) -> np.ndarray:
    """What a tree of ``depth`` levels over one histogram adds in each bin."""
    gain, at = _best_cut(g, h, ridge, least) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], ridge, least, depth - 1), _tree(g[at:], h[at:], ridge, least, depth - 1)])


def _tree_2d(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts one axis once and each side along the other axis: its gain and what it adds."""
    best, out = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(gt)):
            sides, gain = [], -_gain(g.sum(), h.sum(), ridge)
            for part in (slice(None, at), slice(at, None)):
                ga, ha = gt[part].sum(0), ht[part].sum(0)
                more, cut = _best_cut(ga, ha, ridge, least)
                gain += _gain(ga.sum(), ha.sum(), ridge) + more
                leaf = [np.full(len(x), x.sum() / (y.sum() + ridge)) for x, y in ((ga[:cut], ha[:cut]), (ga[cut:], ha[cut:]))]
                sides.append(np.tile(np.concatenate(leaf), (len(gt[part]), 1)))
            if gain > best:
                best = float(gain)
                grid = np.concatenate(sides)
                out = grid.T if turned else grid
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, cycles: int = 120, pair_cycles: int = 40,
                 n_pairs: int = 6, rate: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> Additive:
    """Boost one-feature trees in ``cycles`` rounds over all features, then trees on the ``n_pairs`` pairs that explain
    most of what is left.  Targets lie in 0 to 1; without rows, or with equal targets, only the intercept is fitted."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [_cuts(x[:, f], bins) for f in range(width)]
    model.coarse = [_cuts(x[:, f], coarse_bins) for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.coarse)]
    z = np.full(len(y), model.intercept)
    for _ in range(cycles):
        for f in range(width):
            p = _sigmoid(z)
            g, h = np.bincount(fine[f], y - p, len(model.tables[f])), np.bincount(fine[f], p * (1 - p), len(model.tables[f]))
            step = rate * _tree(g, h, ridge, least)
            model.tables[f] += step
            z += step[fine[f]]

    def grid(i, j):
        p, shape = _sigmoid(z), (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        return (cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p))))

    gains = {(i, j): _tree_2d(*grid(i, j)[1:], ridge, least)[0] for i, j in combinations(range(width), 2)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((len(model.coarse[k[0]]) + 1, len(model.coarse[k[1]]) + 1)) for k in chosen if gains[k] > 0}
    for _ in range(pair_cycles):
        for i, j in model.pairs:
            cell, g, h = grid(i, j)
            step = rate * _tree_2d(g, h, ridge, least)[1]
            model.pairs[i, j] += step
            z += step.ravel()[cell]
    return model


# -- Spark --------------------------------------------------------------------------------

@F.arrow_udf(T.ArrayType(T.DoubleType()))
def features(texts: pa.Array) -> pa.Array:
    """``FEATURES`` of each text."""
    x = measure(texts)
    return lists(x.ravel(), np.arange(len(x) + 1) * len(FEATURES))


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """Rows kept from training: unsigned crc32 of the decimal id is a multiple of ``folds`` (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                  folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of at most ``sample_rows`` labelled ids outside the held-out fold.

    An id with several labels has their mean, null labels and ids are left out; of rows with equal ids the one
    with the least features stands for all.  Ids are taken by the order of their hash.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col, folds))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_target"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)  # bounded by the parameter, hence broadcast
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    met = rows.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("_id", "_target", features("_text").alias("_x"))
    found = met.groupBy("_id").agg(F.min("_x").alias("x"), F.max("_target").alias("y")).orderBy("_id").toArrow()
    y = found.column("y").to_numpy().astype(np.float64)
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(y) else np.empty(0)
    return x.reshape(len(y), len(FEATURES)), y


def scorer(model: Additive):
    """UDF text -> score in 0 to 1, by adding the table entries of the text's bins."""
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(measure(texts)))
    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             folds: int = FOLDS, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS,
             options: Sequence[tuple[str, float]] = ()) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``q``: held_out, score and predicted (1 if the score reaches
    ``threshold``).

    Scores depend on the text alone: null, empty and blank texts share one score, equal texts have equal ones, and texts
    are read whole.  Labels of ids in no row, repeated labels and ids: see ``training_rows``.  Without labelled rows,
    or with one class only, every score is the smoothed share of that class.  An empty table gives no rows.
    ``options`` are passed to ``fit_additive``.
    """
    model = fit_additive(*training_rows(docs, labels, label_col, id_col, text_col, folds, sample_rows), **dict(options))
    scored = docs.select(F.struct("*").alias("row"), scorer(model)(F.col(text_col)).alias("_score"))
    return scored.select("row", F.struct(
        held_out(f"row.{id_col}", folds).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted")).alias("q"))
