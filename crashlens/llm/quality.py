"""Quality rules by distribution divergence from language references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.scratch import Scratch
from crashlens.llm.words import LONGS, Words, record, slices

# Frequent function words by language (a parameter of the operator).
COMMON_WORDS = {
    "en": "the of and to in a is that it for as with was on be by are this from at or an".split(),
    "fr": "le la les de des du et un une en est que qui dans pour sur par pas au avec ce il".split(),
    "de": "der die das und in zu den von mit ist des im für auf nicht ein eine sich dem es als auch".split(),
    "es": "el la los las de y que en un una se del por con para su al es lo como no más".split(),
}
SYMBOLS = "#*$%&|<>"
#: References up to this size are broadcast; more languages than fit are met by an ordinary join.
BROADCAST_BYTES = 8 << 20
CLASSES = ("lower", "upper", "digit", "white", "stop", "symbol", "other", "beyond")

_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
_CLASS[ord("a"):ord("z") + 1] = CLASSES.index("lower")
_CLASS[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
_CLASS[ord("0"):ord("9") + 1] = CLASSES.index("digit")
_CLASS[[9, 10, 11, 12, 13, 32]] = CLASSES.index("white")
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = CLASSES.index("stop")
_CLASS[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
_CLASS[0xC0:] = CLASSES.index("beyond")  # first byte of a character
_INNER = len(CLASSES)
_CLASS[0x80:0xC0] = _INNER  # later bytes of a character

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = record(**{c: T.LongType() for c in _COUNTS}, chars=LONGS, common=LONGS)


def _repeat_words(w: Words) -> np.ndarray:
    """Words in 3-word windows found twice or more in their row."""
    x, whole = w.windows(3)
    start = np.flatnonzero(whole)
    value, doc = x[start], w.doc[start]
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
    twice = np.append(same, False) | np.insert(same, 0, False) if len(v) else np.zeros(0, bool)
    covered = np.zeros(len(w.doc), bool)
    for k in range(3):
        covered[start[order[twice]] + k] = True
    return np.bincount(w.doc[covered], minlength=len(w.count))


def _dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(lines) - len(set(lines))


def measure(words: dict[str, list[str]]):
    """UDF over (text, language): base counts, character classes, common words of the language."""
    width = max((len(v) for v in words.values()), default=0)
    langs = sorted(words)

    @F.arrow_udf(_FEATURES)
    def features(texts: pa.Array, lang: pa.Array) -> pa.Array:
        known = {x: Words(pa.array([" ".join(words[x])]), lower=True).hash for x in langs}
        parts = []
        for lo, hi in slices(texts):
            n, part = hi - lo, texts.slice(lo, hi - lo)
            w = Words(part, lower=True)
            raw = Words(part, hashes=False).data
            kind = _CLASS[raw]
            row = np.repeat(np.arange(n), np.diff(w.row))
            chars = np.bincount(row * (_INNER + 1) + kind, minlength=n * (_INNER + 1)).reshape(n, -1)[:, :_INNER]
            white, symbol = chars[:, CLASSES.index("white")], chars[:, CLASSES.index("symbol")]
            common = np.zeros((n, width), np.int64)
            named = np.array([langs.index(x) if x in words else -1 for x in lang.slice(lo, n).to_pylist()], np.int64)
            for k, x in enumerate(langs):
                mine = np.flatnonzero((named == k)[w.doc])
                order = np.argsort(known[x])
                at = np.searchsorted(known[x][order], w.hash[mine])
                hit = known[x][order][np.minimum(at, len(order) - 1)] == w.hash[mine] if len(order) else np.zeros(0, bool)
                np.add.at(common, (w.doc[mine][hit], order[at[hit]]), 1)
            exact = Words(part)
            lists_of = lambda a: pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel().astype(np.int64)))
            columns = [w.count, chars.sum(1) - white, symbol,
                       [_dup_lines(t) for t in part.to_pylist()], _repeat_words(exact)]
            parts.append(pa.StructArray.from_arrays(
                [*[pa.array(np.asarray(c, np.int64)) for c in columns], lists_of(chars), lists_of(common)],
                [*_COUNTS, "chars", "common"]))
        return pa.concat_arrays(parts)

    return features, width


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms with equal sums of 1."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def judge(docs: DataFrame, max_char_distance: float = 0.28, max_word_distance: float = 0.32, min_words: int = 50,
          max_repeat_percent: int = 50, words: dict[str, list[str]] | None = None, text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``q``: base counts, distances, verdict.

    A language's first references are, bin by bin, the medians of the histograms of all its documents that pass
    the base rules (at least ``min_words`` words, at most ``max_repeat_percent`` of them
    in repeated 3-word windows), so that up to half of them may be junk; the second are the means over those that lie
    within both distances of the first.  A document is kept if it passes the base rules and lies within both
    distances of the second.  Where no document lies near the first references these stay, and all are
    rejected.  Every value of the language column, null too, has references of its own; the word distance is judged for
    languages with a list of common words and texts of at least twice ``min_words`` words, so that chance does not decide.

    Null text has no words and fails the base rules; without a reference (no document of the language passes them)
    the distance is 1.  Very long texts are read whole, repeated rows are judged alike.  Empty table: no rows.  Extra
    columns of any name stay in ``row``.
    """
    words = COMMON_WORDS if words is None else words
    features, width = measure(words)
    scratch = Scratch(docs.sparkSession, "quality")
    lang = F.col(lang_col)
    measured = scratch.save(docs.select(F.struct("*").alias("row"), F.struct(
        lang.alias("ref"), F.coalesce(lang.isin(sorted(words)), F.lit(False)).alias("listed"),
        features(F.col(text_col), lang).alias("f")).alias("q")), "measured")
    f = F.col("q.f")
    failed = (f["n_words"] < min_words) | (100 * f["n_repeat_words"] > max_repeat_percent * f["n_words"])

    def share(hist: Column, total: Column) -> Column:
        return F.transform(hist, lambda x: x / F.greatest(total, F.lit(1)))

    chars = share(f["chars"], F.aggregate(f["chars"], F.lit(0).cast("long"), lambda s, x: s + x))
    hits = F.aggregate(f["common"], F.lit(0).cast("long"), lambda s, x: s + x)
    common = share(F.concat(f["common"], F.array(f["n_words"] - hits)), f["n_words"])
    rows = measured.select("row", F.col("q.ref").alias("_ref"), F.col("q.listed").alias("_listed"), f.alias("_f"),
                           failed.alias("_failed"), chars.alias("_chars"), common.alias("_common"))
    bins = [(c, i) for c, n in (("_chars", _INNER), ("_common", width + 1)) for i in range(n)]

    def centres(kept: DataFrame) -> DataFrame:
        """Medians by language, in whole thousandths (exact, and of bounded size while they are gathered), scaled to 1."""
        medians = kept.groupBy("_ref").agg(*[
            F.percentile(F.round(F.col(c)[i] * 1000), 0.5).alias(f"{c}{i}") for c, i in bins])

        def scaled(of: str) -> Column:
            values = F.array(*[F.col(f"{c}{i}") for c, i in bins if c == of])
            return share(values, F.aggregate(values, F.lit(0.0), lambda s, x: s + x))

        return scratch.save(medians.select(F.col("_ref").alias("_lang"), *[
            scaled(c).alias(f"{c}_ref") for c in ("_chars", "_common")]), "first")

    def references(kept: DataFrame, name: str) -> DataFrame:
        """Mean histograms by language.  Sums of whole millionths, so that reruns agree to the last bit."""
        sums = kept.groupBy("_ref").agg(F.count("*").alias("_docs"), *[
            F.sum(F.round(F.col(c)[i] * 1_000_000).cast("long")).alias(f"{c}{i}") for c, i in bins])
        return scratch.save(sums.select(F.col("_ref").alias("_lang"), *[
            F.array(*[F.col(f"{c}{i}") / (F.col("_docs") * 1_000_000) for b, i in bins if b == c]).alias(f"{c}_ref")
            for c in ("_chars", "_common")]), name)

    def compared(refs: DataFrame) -> DataFrame:
        if refs.count() * len(bins) * 8 <= BROADCAST_BYTES:  # one row a language
            refs = F.broadcast(refs)
        joined = rows.join(refs, F.col("_ref").eqNullSafe(F.col("_lang")), "left")
        unjudged = ~F.col("_listed") | (F.col("_f.n_words") < 2 * min_words)
        return joined.withColumns({
            "_char_d": F.coalesce(_distance(F.col("_chars"), F.col("_chars_ref")), F.lit(1.0)),
            "_word_d": F.when(unjudged, F.lit(0.0)).otherwise(
                F.coalesce(_distance(F.col("_common"), F.col("_common_ref")), F.lit(1.0)))})

    near = ~F.col("_failed") & (F.col("_char_d") <= max_char_distance) & (F.col("_word_d") <= max_word_distance)
    first = centres(rows.where(~F.col("_failed")))
    trimmed = references(compared(first).where(near), "trimmed")
    again = trimmed.select(F.col("_lang").alias("_same"), *[F.col(f"{c}_ref").alias(f"{c}_mean") for c in ("_chars", "_common")])
    refs = first.join(again, F.col("_lang").eqNullSafe(F.col("_same")), "left").select(
        "_lang", *[F.coalesce(f"{c}_mean", f"{c}_ref").alias(f"{c}_ref") for c in ("_chars", "_common")])
    return compared(scratch.save(refs, "refs")).select("row", F.struct(
        *[F.col("_f")[c].alias(c) for c in _COUNTS],
        F.col("_failed").alias("base_failed"), F.col("_char_d").alias("char_distance"),
        F.col("_word_d").alias("word_distance"), near.alias("kept")).alias("q"))
