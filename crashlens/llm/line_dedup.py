"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch
from crashlens.llm.words import WHITE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(key: Column) -> Column:
    """128 bits of the key: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs (line hash, owner, number of documents), each sorted by hash.

    Batches come newest ids first, so a line belongs to the batch that brings it
    first: ``add`` anti-joins the batch with the runs, gives the lines that none of
    them holds to the batch's largest id, and stores these together with the counts of
    the known ones as a run of level 0.  When a level has ``fanout`` runs they are
    compacted into one run of the next level.
    """

    def __init__(self, scratch: Scratch, fanout: int = 4):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[DataFrame]] = []
        self.made = 0

    def _store(self, run: DataFrame, level: int) -> None:
        self.made += 1
        stored = self.scratch.save(run.sortWithinPartitions("h"), f"run-{self.made}-level-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stored)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merged(self.levels[level])
            self.levels[level] = []
            self._store(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for run in runs[1:]:
            both = both.unionByName(run)
        return both.groupBy("h").agg(F.max("owner").alias("owner"), F.sum("n_docs").alias("n_docs"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """``lines``: (id, h), all ids smaller than those of earlier batches."""
        batch = lines.groupBy("h").agg(F.max("id").alias("owner"), F.count_distinct("id").alias("n_docs"))
        if runs := self.runs():
            batch = self.scratch.save(batch, f"batch-{self.made}")
            held = runs[0].select("h")
            for run in runs[1:]:
                held = held.union(run.select("h"))
            known = batch.join(held, "h", "left_semi")
            batch = batch.join(held, "h", "left_anti").unionByName(
                known.withColumn("owner", F.lit(None).cast(batch.schema["owner"].dataType)))
        self._store(batch, 0)

    def held(self) -> DataFrame:
        """All runs as one."""
        return self._merged(self.runs())


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4,
                fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points or more and is found in
    ``min_docs`` documents or more, except in the largest id that holds it.

    Batches are ranges of the (integer) ids, newest first, added to ``LineRuns`` one
    after another; a second sweep joins the lines with the runs and gathers, for each
    id, the hashes that it loses.

    Output: id, text (kept lines joined by a newline), n_lines, n_dropped.  Null or empty
    text is one empty line.  Rows that share an id count as one document and lose
    the same lines.  A null id counts as no document and never owns a line, so such
    rows lose every repeated line.  Empty table: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bounds = base.agg(F.percentile_approx("id", [i / n_batches for i in range(1, n_batches)])).first()[0] or []
    older = sum(((F.col("id") <= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    long_lines = F.filter(_text_lines(F.col("text")), lambda x: F.char_length(F.btrim(x, F.lit(WHITE))) >= min_chars)
    lines = scratch.save(
        base.select("id", F.coalesce(older, F.lit(n_batches - 1)).cast("int").alias("batch"),
                    F.explode(F.transform(long_lines, lambda x: _hash(line_key(x)))).alias("h")),
        "lines", partition_by="batch")
    runs = LineRuns(scratch, fanout)
    for batch in range(n_batches):
        runs.add(lines.where(F.col("batch") == batch).select("id", "h"))
    repeated = scratch.save(runs.held().where(F.col("n_docs") >= min_docs), "repeated")
    drops = (lines.join(repeated, "h").where(~F.col("id").eqNullSafe(F.col("owner")))
             .groupBy("id").agg(F.collect_set("h").alias("drop")))
    found = base.join(drops, base["id"].eqNullSafe(drops["id"]), "left").select(base["id"], "text", "drop")
    rows = found.withColumn("lines", _text_lines(F.col("text")))
    kept = F.filter("lines", lambda x: ~((F.char_length(F.btrim(x, F.lit(WHITE))) >= min_chars)
                                         & F.array_contains(F.col("drop"), _hash(line_key(x)))))
    rows = rows.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept))
    return rows.select(
        F.col("id").alias(id_col), F.array_join("kept", "\n").alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
