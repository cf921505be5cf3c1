"""URL filter: host and path rules, and a character language-model ratio for the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch
from crashlens.llm.words import LONGS, lists, record, slices, text_bytes

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDERS = 5  # contexts of 0 to 4 characters
BITS = 9  # of a symbol
UNIT = 1 << 32  # log-ratios are whole multiples of 1 / UNIT
BINS = 400  # score bins for the threshold, over -4 to 4
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> dict[str, Column]:
    """host, path, and what follows the first ``://`` with A-Z lower-cased."""
    text = F.coalesce(url, F.lit(""))
    part = lambda pattern: F.regexp_extract(text, f"(?s)^.*?://{pattern}", 1)
    return {"host": F.translate(part("([^/?#]*)"), _UP, _LOW), "path": part("[^/?#]*([^?#]*)"),
            "rest": F.translate(part("(.*)$"), _UP, _LOW)}


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits host and path as struct(verdict, rule); null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


_GRAMS = record(gram=LONGS, n=LONGS)


def _grams(texts: pa.Array) -> pa.Array:
    """Each text's distinct grams, the symbols (byte + 1) of a character and of the ``ORDERS - 1``
    before it, and how often each stands.  A symbol fills ``BITS`` bits, the newest the lowest
    ones, and is 0 before the first character; so equal numbers are equal grams."""
    parts = []
    for lo, hi in slices(texts):
        data, row = text_bytes(texts.slice(lo, hi - lo))
        place = np.arange(len(data)) - np.repeat(row[:-1], np.diff(row))
        symbol = data.astype(np.int64) + 1
        gram = symbol.copy()
        for k in range(1, ORDERS):
            older = np.zeros(len(data), np.int64)
            older[k:] = symbol[:-k]
            gram |= np.where(place < k, 0, older) << BITS * k
        doc = np.repeat(np.arange(hi - lo), np.diff(row))
        order = np.lexsort((gram, doc))
        gram, doc = gram[order], doc[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        ends = np.searchsorted(doc[at], np.arange(hi - lo + 1))
        parts.append(pa.StructArray.from_arrays(
            [lists(gram[at], ends), lists(np.diff(np.append(at, len(gram))), ends)], ["gram", "n"]))
    return pa.concat_arrays(parts)


def model(counts: DataFrame, strength: float) -> DataFrame:
    """(gram, ratio) from (gram, allow, block): log-likelihood ratio of each gram's last character
    (allowed over blocked) in whole ``UNIT``-ths, so that sums do not depend on their order.

    Each order's estimate (n(context, c) + strength * shorter order) / (n(context) + strength)
    backs off to the next shorter context; order 0 backs off to 1 / 256.  A context goes
    before at most 256 characters and follows on at most 257, so no key is hot.
    """
    labels, shorter = ("allow", "block"), None
    for k in range(ORDERS):
        own = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("gram")).agg(
            *[F.sum(x).alias(x) for x in labels])
        before = Window.partitionBy(F.shiftright("gram", BITS))
        own = own.withColumns({f"{x}_all": F.sum(x).over(before) for x in labels})
        if shorter is None:
            own = own.withColumns({f"{x}_p": F.lit(1 / 256) for x in labels})
        else:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(
                shorter.withColumnRenamed("gram", "suffix"), "suffix")
        shorter = own.select("gram", *[((F.col(x) + strength * F.col(f"{x}_p")) / (F.col(f"{x}_all") + strength)).alias(f"{x}_p")
                                       for x in labels])
    return shorter.select("gram", F.round((F.log("allow_p") - F.log("block_p")) * UNIT).cast("long").alias("ratio"))


def best_threshold(bins: list[tuple[int, int, int]]) -> float:
    """From (label, bin, n): the threshold with the best balanced accuracy, nearest to 0 of equals;
    0 if a class is missing."""
    counts = np.zeros((2, BINS + 1), np.int64)
    for label, b, n in bins:
        counts[label, b] += n
    if not counts.sum(1).all():
        return 0.0
    share = counts / counts.sum(1, keepdims=True)
    passed = share[:, ::-1].cumsum(1)[:, ::-1]  # share of a class at or above a bin
    gain = np.round(passed[1] - passed[0], 9)
    edges = (np.arange(BINS + 1) - BINS / 2) * 8 / BINS
    best = np.flatnonzero(gain == gain.max())
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, strength: float = 4.0,
                held_out: int = 5, url_col: str = "url") -> DataFrame:
    """``row`` (a struct of all columns of ``pages``) and ``u``: host, path, rule, verdict, score.

    The longest fitting rule decides.  URLs that a rule decides also teach the models: two
    variable-order character models, of the allowed and of the blocked, counted over all of
    them but every ``held_out``-th by hash; those fix the threshold.  The exact counts are a
    table with a row for each distinct gram, joined with the grams of each distinct URL.
    Other URLs are allowed if their mean log-likelihood ratio reaches the threshold.

    A null url, or one without ``://``, has an empty host and path, fits no rule and scores 0.
    Repeated urls are judged alike and each counts in the models.  If one class has no
    URL, the threshold is 0.  Empty table: no rows.  Extra columns of any name
    stay in ``row``.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    parts = url_parts(F.col(url_col))
    rows = pages.select(F.struct("*").alias("row"), F.struct(*[v.alias(k) for k, v in parts.items()]).alias("u"))
    rows = rows.withColumns({"_rule": longest_rule(F.col("u.host"), F.col("u.path"), rules),
                             "_t1": F.xxhash64("u.rest"), "_t2": F.xxhash64(F.lit("rest"), F.col("u.rest"))})
    held = F.pmod(F.xxhash64("text"), F.lit(held_out)) == 0
    count = lambda fits: F.coalesce(F.sum(fits.cast("long")), F.lit(0))
    texts = scratch.save(rows.select(F.col("u.rest").alias("text"), "_t1", "_t2", F.col("_rule.verdict").alias("v")).groupBy(
        "text", "_t1", "_t2").agg(*[count(F.col("v") == v).alias(v) for v in ("allow", "block")]), "texts")
    grams = F.arrow_udf(_grams, _GRAMS)
    each = texts.withColumns({"held": held, "g": grams(F.col("text"))})
    taught = lambda v: F.when(F.col("held"), F.lit(0)).otherwise(F.col(v)).cast("long")
    each = scratch.save(each.select("_t1", "_t2", *[taught(v).alias(v) for v in ("allow", "block")], F.explode(
        F.arrays_zip(F.col("g.gram").alias("gram"), F.col("g.n").alias("n"))).alias("g")).select(
        "_t1", "_t2", "allow", "block", "g.gram", "g.n"), "grams")
    counts = scratch.save(each.groupBy("gram").agg(*[F.sum(F.col(v) * F.col("n")).alias(v) for v in ("allow", "block")]), "counts")
    ratios = scratch.save(model(counts, strength), "model")
    sums = each.select("_t1", "_t2", "gram", "n").join(ratios, "gram").groupBy("_t1", "_t2").agg(
        F.round(F.sum(F.col("n") * F.col("ratio")) / UNIT / F.sum("n"), 9).alias("_score"))
    scores = scratch.save(texts.select("_t1", "_t2", "allow", "block", held.alias("held")).join(sums, ["_t1", "_t2"], "left")
                          .withColumn("_score", F.coalesce("_score", F.lit(0.0))), "scores")
    bin_ = F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(F.col("_score") * BINS / 8) + BINS // 2)).cast("int")
    bins = scores.where("held").groupBy(bin_.alias("bin")).agg(F.sum("block"), F.sum("allow")).collect()  # at most BINS + 1
    threshold = best_threshold([(label, r[0], r[label + 1]) for r in bins for label in (0, 1)])
    judged = rows.join(scores.select("_t1", "_t2", "_score"), ["_t1", "_t2"], "left")
    method = F.when(F.col("_score") >= threshold, "allow").otherwise("block")
    return judged.select("row", F.struct(
        F.col("u.host").alias("host"), F.col("u.path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", method).alias("verdict"), F.col("_score").alias("score")).alias("u"))
