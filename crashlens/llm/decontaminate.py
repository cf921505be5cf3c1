"""Benchmark decontamination by templates (DataFrame functions only).

Numbers, units after numbers and capitalised names become typed placeholders, so that a question
whose slots were filled anew keeps its template.  Documents are met through hashes of
8-word template windows, and a match counts where the slots' fillings correspond.  Beside
the templates, items are found by verbatim runs of words, short items as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch

# Units recognised after a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l ms s sec min h hr hours hour minutes minute seconds second "
         "days day weeks week months month years year percent usd eur dollars dollar euros euro cents cent miles mile "
         "meters metres meter metre kilometers kilometres grams gram kilograms liters litres degrees")
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
WINDOW = 8
MIN_LITERALS = 4
VERBATIM = 13  # words of a verbatim run
SIGNS = "=+<>*^×÷/−-"
BROADCAST_ROWS = 1_000_000


def _marked(text: Column, fill: bool) -> Column:
    """Text with typed marks for slots, each followed by its filling if ``fill``; lower case."""
    value = "$0" if fill else ""
    x = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   ")
    x = F.regexp_replace(x, r"(?<!\p{L})\p{Lu}[\p{Ll}\p{M}]+(?!\p{L})", f" {NAME}{value} ")
    x = F.regexp_replace(x, r"[0-9][0-9.,:/]*", f" {NUMBER}{value} ")
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    after = rf"({NUMBER}[0-9.,:/]* )\s*({units}|%)(?![\p{{L}}\p{{N}}])"
    return F.lower(F.regexp_replace(x, after, f"$1 {UNIT}{'$2' if fill else ''} "))


def template(text: Column) -> Column:
    """Words of the template: lower-case words, or a slot's mark."""
    return F.regexp_extract_all(_marked(text, False), F.lit(r"[\p{L}\p{M}\p{N}\x01-\x03]+"), F.lit(0))


def fillings(text: Column) -> Column:
    """The template's words, slots with their fillings; as many as ``template`` has."""
    return F.regexp_extract_all(
        _marked(text, True), F.lit(r"\x02[0-9.,:/]+|\x03%|[\p{L}\p{M}\p{N}\x01\x03]+"), F.lit(0))


def exact(text: Column) -> Column:
    """The words of ``fillings`` without punctuation after numbers, each after the signs of
    arithmetic that stand alone before it."""
    words = F.regexp_extract_all(_marked(text, True), F.lit(
        rf"(?:[{SIGNS}]\s+)*(?:\x02[0-9.,:/]+|\x03%|[\p{{L}}\p{{M}}\p{{N}}\x01\x03]+)"), F.lit(0))
    return F.transform(words, lambda x: F.rtrim(F.translate(x, " \t\n\x0b\f\r", ""), F.lit(".,:/")))


def _runs(words: str, n: Column) -> Column:
    """array<struct<at, len, h, x>> of the runs of ``n`` words, without signs before the first."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

    def run(i: Column) -> Column:
        x = F.concat(F.array(F.ltrim(F.get(words, i), F.lit(SIGNS))), F.slice(F.col(words), i + 2, n - 1))
        return F.struct(i.alias("at"), n.alias("len"), F.xxhash64(x).alias("h"), x.alias("x"))

    return F.transform(starts, run)


def _windows(words: str) -> Column:
    """array<struct<at, h>> of the windows, one at every word that has enough after it."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.xxhash64(F.slice(F.col(words), i + 1, F.lit(WINDOW))).alias("h")))


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of its rows; larger tables are joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, min_cover: float = 0.5, text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(t1, t2, item, n_windows, cover, n_slots): texts, by their two hashes, and the items they hold.

    An item is held if ``min_cover`` of its template windows, those with at least
    ``MIN_LITERALS`` plain words, stand in the text.  Along each run of aligned windows, equal
    fillings of the item must meet equal fillings of the text; runs where they do not are
    left out.

    An item is also held if any run of ``VERBATIM`` of its words stands verbatim in the text, but
    for runs aligned with such unequal fillings, or, with fewer words, if the whole item
    does, however short it is.  Verbatim is up to case, white space and punctuation; capitalised
    words, numbers, units and signs of arithmetic between words must agree.  ``n_windows`` counts
    template windows; ``cover`` is their share, or that of the verbatim runs if the item has no
    such window.  Texts are first met by the hashes of their windows at every word, so any shared
    window is found wherever it stands; windows are compared word by word in texts so met.

    Items without words match nothing.  Null or empty texts hold nothing; equal texts and repeated items
    are judged once.  Empty tables: no rows.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).dropDuplicates()
    items = items.select("item", template(F.col("text")).alias("w"), fillings(F.col("text")).alias("v"),
                         exact(F.col("text")).alias("e"))
    every = items.select(F.explode(_windows("w")).alias("p")).select("p.h")
    size = F.least(F.size("e"), F.lit(VERBATIM))
    runs = items.where(F.size("e") > 0).select("item", (F.size("e") - size + 1).alias("runs"), F.explode(_runs("e", size)).alias("r"))
    runs = runs.select("item", "runs", "r.*")
    runs = scratch.save(runs.withColumnRenamed("at", "item_at"), "runs")
    lengths = sorted(r[0] for r in runs.select("len").distinct().collect())  # at most VERBATIM
    parts = items.select("item", "w", "v", F.explode(_windows("w")).alias("p"))
    plain = F.size(F.filter(F.slice("w", F.col("p.at") + 1, F.lit(WINDOW)), lambda x: x > F.lit("\x04")))
    parts = scratch.save(parts.where(plain >= MIN_LITERALS).select(
        "item", F.col("p.at").alias("item_at"), F.col("p.h").alias("h"),
        F.slice("w", F.col("p.at") + 1, F.lit(WINDOW)).alias("item_w"),
        F.slice("v", F.col("p.at") + 1, F.lit(WINDOW)).alias("item_v")), "items")
    whole = parts.groupBy("item").agg(F.count_distinct("item_at").alias("of"))
    # a verbatim run of WINDOW words or more shares a template window
    hashes = _sized(every.union(runs.where(F.col("len") < WINDOW).select("h")).distinct())

    texts = docs.select(F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("t2"),
                        F.col(text_col).alias("text"))
    words = texts.withColumns({"w": template(F.col("text")), "e": exact(F.col("text"))})
    seen = F.concat(*[F.transform(x, lambda p: p["h"]) for x in (
        _windows("w"), *[_runs("e", F.lit(n)) for n in lengths if n < WINDOW])])
    met = (words.select("t1", "t2", F.explode(seen).alias("h"))
           .join(hashes, "h", "left_semi").select("t1", "t2").distinct())
    met = scratch.save(met, "met")
    near = texts.join(_sized(met), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    near = scratch.save(near.select("t1", "t2", template(F.col("text")).alias("w"), fillings(F.col("text")).alias("v"),
                                    exact(F.col("text")).alias("e")), "near")
    here = near.select("t1", "t2", "w", "v", F.explode(_windows("w")).alias("p")).select(
        "t1", "t2", F.col("p.at").alias("at"), F.col("p.h").alias("h"),
        F.slice("w", F.col("p.at") + 1, F.lit(WINDOW)).alias("doc_w"), F.slice("v", F.col("p.at") + 1, F.lit(WINDOW)).alias("doc_v"))
    hits = here.join(_sized(parts), "h").where("doc_w = item_w")
    hits = scratch.save(hits.select("t1", "t2", "item", "item_at", (F.col("at") - F.col("item_at")).alias("run"),
                                    F.filter(F.arrays_zip("item_w", "item_v", "doc_v"), lambda x: x["item_w"] < F.lit("\x04")).alias("slots")), "hits")
    run = ["t1", "t2", "item", "run"]
    slots = hits.select(*run, F.explode("slots").alias("s")).select(*run, "s.*")
    clash = (slots.groupBy(*run, "item_v").agg(F.count_distinct("doc_v").alias("c")).where("c > 1").select(*run).distinct())
    good = hits.join(clash, run, "left_anti")
    held = good.groupBy("t1", "t2", "item").agg(
        F.count_distinct("item_at").alias("n_windows"), F.max(F.size("slots")).alias("n_slots"))
    held = held.join(whole, "item")

    same = reduce(DataFrame.unionByName, [near.select("t1", "t2", F.explode(_runs("e", F.lit(n))).alias("r")).select("t1", "t2", "r.*")
                                          for n in lengths or [VERBATIM]])
    same = same.join(_sized(runs.withColumnsRenamed({"h": "item_h", "len": "item_len", "x": "item_x"})),
                     (F.col("h") == F.col("item_h")) & (F.col("len") == F.col("item_len"))).where("x = item_x")
    same = same.withColumn("run", F.col("at") - F.col("item_at"))
    same = same.where("runs = 1").unionByName(same.where("runs > 1").join(clash, run, "left_anti"))
    slots = F.size(F.filter("x", lambda x: F.ltrim(x, F.lit(SIGNS)) < F.lit("\x04")))
    same = same.groupBy("t1", "t2", "item").agg((F.count_distinct("item_at") / F.max("runs")).alias("share"), F.max(slots).alias("n_same"))
    held = held.join(same, ["t1", "t2", "item"], "full").where((F.col("n_windows") >= min_cover * F.col("of")) | F.col("share").isNotNull())
    return scratch.save(held.select(
        "t1", "t2", "item", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce(F.col("n_windows") / F.col("of"), "share").alias("cover"),
        F.coalesce("n_slots", "n_same").cast("long").alias("n_slots")), "held")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id") -> DataFrame:
    """One row for each row of ``docs`` and item that it holds: id, item, n_windows, cover, n_slots."""
    found = leaks(docs, benchmark, text_col=text_col, item_col=item_col)
    keys = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("t2"))
    return keys.join(_sized(found), ["t1", "t2"]).select(
        F.col("_id").alias(id_col), F.col("item").alias(item_col), "n_windows", "cover", "n_slots")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns and repeated rows stay."""
    found = _sized(leaks(docs, benchmark, text_col=text_col).select("t1", "t2").distinct())
    here = (F.xxhash64(docs[text_col]) == found["t1"]) & (F.xxhash64(F.lit("text"), docs[text_col]) == found["t2"])
    return docs.join(found, here, "left_anti")
