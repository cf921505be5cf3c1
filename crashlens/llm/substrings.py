"""Repeated word windows by level-wise doubling.

The first level takes windows of half the length, and of these only each row's anchors:
a window's anchor is the half window with the least hash in it, so two equal windows
have the same anchor wherever they stand.  Anchors found once in the corpus are given up
with every window that they anchor.  What survives is extended to twice the length by
joining the hashes of two half windows, and is counted again at full length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashlens.llm.order import prefix_sums
from crashlens.llm.scratch import Scratch
from crashlens.llm.words import LONGS, Words, join_windows, lists, longs, mix, record, slices

BROADCAST_ROWS = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _anchors(half: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each of ``size`` windows, the place of the first least of its half windows."""
    least, at = half[:size].copy(), np.zeros(size, np.int64)
    for k in range(1, n + 1):
        nxt = half[k:k + size]
        less = nxt < least
        least[less] = nxt[less]
        at[less] = k
    return at + np.arange(size)


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Half-window hashes, full-window hashes, which full windows stay in a row, anchors."""
    n = window // 2
    half, _ = w.windows(n)
    size = max(0, len(w.hash) - window + 1)
    full = join_windows(half[:size], half[n:n + size])
    return half, full, w.left[:size] >= window, _anchors(half, size, n)


def _by_row(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (row, value), ties by place; which are first and last of their value in the row."""
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    last = np.append(first[1:], True)[:len(v)]
    return order, first, last


def _row_lists(value: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    return lists(longs(value), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]))


def _digests(w: Words, keep: np.ndarray) -> list[str]:
    out, at = w.kept_bytes(keep)
    view = memoryview(out)
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _first_level(window: int):
    @F.arrow_udf(record(words=T.LongType(), sha=T.StringType(), once=LONGS, more=LONGS))
    def first_level(texts: pa.Array) -> pa.Array:
        """Words, digest of the whole row, and its anchors: found once in it, and more often."""
        parts = []
        for lo, hi in slices(texts):
            w = Words(texts.slice(lo, hi - lo))
            half, _, whole, at = _windows(w, window)
            place = np.unique(at[whole])
            value, doc = half[place], w.doc[place]
            order, first, last = _by_row(value, doc)
            value, doc = value[order], doc[order]
            lone = first & last
            n = hi - lo
            parts.append(pa.StructArray.from_arrays(
                [pa.array(w.count.astype(np.int64)), pa.array(_digests(w, np.ones(len(w.doc), bool)), pa.string()),
                 _row_lists(value[lone], doc[lone], n), _row_lists(value[first & ~last], doc[first & ~last], n)],
                ["words", "sha", "once", "more"]))
        return pa.concat_arrays(parts)
    return first_level


def _flat(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _second_level(window: int):
    @F.arrow_udf(record(windows=LONGS, inner=T.BooleanType()))
    def second_level(texts: pa.Array, anchors: pa.Array) -> pa.Array:
        """Distinct full windows whose anchor survived; whether one is found twice in the row."""
        parts = []
        for lo, hi in slices(texts):
            w = Words(texts.slice(lo, hi - lo))
            half, full, whole, at = _windows(w, window)
            alive = whole & np.isin(half[at], _flat(anchors.slice(lo, hi - lo)))
            value, doc = full[alive], w.doc[:len(full)][alive]
            order, first, _ = _by_row(value, doc)
            n = hi - lo
            inner = np.bincount(doc[order][~first], minlength=n) > 0
            parts.append(pa.StructArray.from_arrays(
                [_row_lists(value[order][first], doc[order][first], n), pa.array(inner)], ["windows", "inner"]))
        return pa.concat_arrays(parts)
    return second_level


def _remove(window: int):
    @F.arrow_udf(record(removed=T.LongType(), sha=T.StringType()))
    def remove(texts: pa.Array, seen: pa.Array) -> pa.Array:
        """Words covered by windows seen before, in earlier rows or this one; digest of the rest."""
        parts = []
        for lo, hi in slices(texts):
            w = Words(texts.slice(lo, hi - lo))
            _, full, whole, _ = _windows(w, window)
            start = np.flatnonzero(whole)
            value, doc = full[start], w.doc[start]
            order, first, _ = _by_row(value, doc)
            again = np.zeros(len(start), bool)
            again[order[~first]] = True
            part = seen.slice(lo, hi - lo)
            owner = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
            salt = lambda v, d: mix(v ^ mix(d.astype(np.uint64) + np.uint64(1)))
            again |= np.isin(salt(value, doc), salt(_flat(part), owner))
            depth = np.zeros(len(w.doc) + 1, np.int64)
            depth[start[again]] += 1
            depth[start[again] + window] -= 1
            keep = np.cumsum(depth[:-1]) == 0
            parts.append(pa.StructArray.from_arrays(
                [pa.array(np.bincount(w.doc[~keep], minlength=hi - lo).astype(np.int64)),
                 pa.array(_digests(w, keep), pa.string())], ["removed", "sha"]))
        return pa.concat_arrays(parts)
    return remove


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts earlier: in a
    smaller id, or in the same row before.  Windows are judged on the input.

    Output: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).
    Null, empty and blank texts have no words.  Rows with equal texts are one node: the
    first (smallest id, nulls last, then stored order) is judged, and the others lose all
    their words if they fill a window.  Rows that share an id but not the text follow
    stored order.  Empty table: no rows.  Other columns are ignored.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("text"), "text")})
    rows = scratch.save(base.withColumn("f", _first_level(window)("text")).select(
        "id", "t1", "t2", F.monotonically_increasing_id().alias("rid"), "f.*"), "rows")
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    classes = rows.where(F.col("words") >= window).groupBy("t1", "t2").agg(lead.alias("lead")).select("t1", "t2", "lead.*")
    nodes = scratch.save(prefix_sums(classes, ["none", "id", "rid"], {}, scratch, "classes")
                         .withColumnRenamed("position", "node"), "nodes")
    n_nodes = nodes.count()

    def with_text(side: DataFrame) -> DataFrame:
        """The texts of ``side``'s nodes.  Few keys are sent to all tasks first, so that no other text moves."""
        side = side.join(nodes.select("node", "t1", "t2", F.col("id").alias("own_id")), "node")
        keys = ["t1", "t2"]
        only = base
        if n_nodes <= BROADCAST_ROWS:
            only = only.join(F.broadcast(side.select(*keys)), keys, "left_semi")
        return only.join(side, keys).where(F.col("id").eqNullSafe(F.col("own_id")))

    def own_anchors(kind: str) -> DataFrame:
        return rows.join(nodes.select("node", "rid"), "rid").select("node", F.explode(kind).alias("h"))

    once, more = own_anchors("once"), own_anchors("more")
    common = (once.select("h", F.lit(1).alias("c")).unionAll(more.select("h", F.lit(2).alias("c")))
              .groupBy("h").agg(F.sum("c").alias("c")).where("c > 1").select("h"))
    common = scratch.save(common, "anchors")
    alive = scratch.save(once.unionAll(more).join(common, "h").groupBy("node").agg(F.collect_list("h").alias("anchors")), "alive")
    second = with_text(alive).select("node", _second_level(window)("text", "anchors").alias("s"))
    second = scratch.save(second.select("node", "s.*").where("size(windows) > 0").dropDuplicates(["node"]), "windows")

    each = second.select("node", F.explode("windows").alias("h"))
    shared = scratch.save(each.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                          .where("lo < hi").select("h", "lo"), "shared")
    later = each.join(shared, "h").where("node > lo").groupBy("node").agg(F.collect_list("h").alias("seen"))
    touched = (second.select("node", "inner").join(later, "node", "left").where("inner or seen is not null")
               .select("node", F.coalesce("seen", F.array().cast("array<long>")).alias("seen")))
    touched = scratch.save(touched, "touched")
    cut = with_text(touched).select("node", _remove(window)("text", "seen").alias("c")).select("node", "c.*")
    cut = scratch.save(cut.dropDuplicates(["node"]), "cut")

    judged = nodes.join(cut, "node", "left").select("t1", "t2", F.col("rid").alias("lead"), "removed", F.col("sha").alias("cut_sha"))
    out = rows.drop("once", "more").join(judged, ["t1", "t2"], "left")
    copy = F.col("lead").isNotNull() & (F.col("rid") != F.col("lead"))
    return out.select(
        F.col("id").alias(id_col), F.col("words").alias("n_words"),
        F.when(copy, F.col("words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
