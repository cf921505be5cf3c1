"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target words, the rates nearest to one
copy each (least sum of r ln r - r) with r <= 2 are r = min(2, exp(lambda * size)), one
multiplier a source.  The multipliers solve the convex dual; Newton steps on the logarithm of
its gradient, guarded by a bracket, are sums over (source, size) classes.  Rates become
whole copies class by class, carrying the rounding error to smaller sizes.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch
from crashlens.llm.words import WORD

UNIT = 1 << 32  # rates are whole multiples of 1 / UNIT, so that sums do not depend on their order
BROADCAST_ROWS = 1_000_000
RANK_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150,
                   most: int = 2) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size): sources by code point, null
    last, weigh ``weights`` in turn and share ``percent`` of all words; none gets more than
    ``most`` times its size, and what it leaves goes to the others by weight.

    With caps c and weights w, the targets are min(c, w t).  In order of c / w, the first
    source that t = (rest of the budget) / (rest of the weights) leaves uncapped fixes t.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    exact = "decimal(38,0)"
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (
        (F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast(exact))
    rows = rows.withColumns({"cap": (F.col("source_size") * most).cast(exact),
                             "all": F.sum(F.col("source_size").cast(exact)).over(Window.partitionBy())})
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "key")
    rows = rows.withColumns({
        "before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(exact),
        "weight": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).cast(exact)})
    # budget in hundredths: percent * all - 100 * capped sizes
    rows = rows.withColumn("rest", (percent * F.col("all") - 100 * F.col("before")).cast(exact))
    open_ = 100 * F.col("cap") * F.col("weight") >= F.col("w") * F.col("rest")
    first = F.min(F.when(open_, F.struct(F.col("cap") / F.col("w"), "key", "rest", "weight"))).over(Window.partitionBy())
    share = F.col("w") * first["rest"]
    capped = first.isNull() | (100 * F.col("cap") * first["weight"] < share)
    return rows.select("key", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(
        share.cast("double") / (100 * first["weight"]).cast("double")).alias("target"))


def _rate() -> Column:
    """Fixed-point min(2, exp(lam * size / mean)); class and source columns in one row."""
    tilt = F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(2)))
    return F.round(F.exp(tilt) * UNIT).cast("long")


def solve(classes: DataFrame, sources: DataFrame, scratch: Scratch, rounds: int = 20, steps: int = 3,
          tolerance: float = 1e-7) -> DataFrame:
    """``sources`` with the multiplier ``lam`` of each (in units of 1 / mean size)."""
    top = F.col("mean") * math.log(2)  # at this multiplier every rate is 2
    state = sources.withColumns({
        "lam": F.when(F.col("target") >= 2 * F.col("source_size"), top).otherwise(F.lit(0.0)),
        "lo": F.lit(None).cast("double"), "hi": top, "miss": F.lit(1.0)})
    columns = state.columns
    for r in range(rounds):
        for _ in range(steps):
            x = F.col("size").cast("decimal(20,0)") * F.col("docs")
            sums = (classes.join(state, "key").withColumn("rate", _rate()).groupBy("key").agg(
                F.sum((x * F.col("rate")).cast("decimal(38,0)")).alias("g"),
                F.sum(F.when(F.col("rate") < 2 * UNIT, (x * F.col("size") * F.col("rate")).cast("decimal(38,0)"))
                      .otherwise(0).cast("decimal(38,0)")).alias("slope")))
            s = state.join(sums, "key").withColumns({
                "g": F.col("g").cast("double") / UNIT, "slope": F.col("slope").cast("double") / UNIT / F.col("mean")})
            s = s.withColumns({
                "miss": F.when(F.col("target") > 0, F.abs(F.col("g") / F.col("target") - 1)).otherwise(F.lit(0.0)),
                "lo": F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("lo")),
                "hi": F.when(F.col("g") >= F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
            newton = F.col("lam") + F.when(F.col("slope") > 0, F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("slope"))
            inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (newton < F.col("hi"))
            halved = F.when(F.col("lo").isNull(), F.col("lam") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
            state = s.withColumn("lam", F.when(F.col("miss") <= tolerance, F.col("lam")).when(inside, newton)
                                 .otherwise(halved)).select(*columns)
        state = scratch.save(state, f"dual-{r}")
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state


def _whole_copies(group: pd.DataFrame) -> pd.DataFrame:
    """Copies of each (source, size) class, largest sizes first, tracking the wanted words."""
    group = group.sort_values("size", ascending=False)
    wanted, taken, copies = 0, 0, []
    for size, docs, rate in zip(group["size"].tolist(), group["docs"].tolist(), group["rate"].tolist(), strict=True):
        wanted += size * docs * rate
        if size == 0:
            copies.append(docs)
            continue
        want = wanted - taken * UNIT
        whole = -((size * UNIT - 2 * want) // (2 * size * UNIT))  # nearest, halves down
        whole = min(max(whole, 0), 2 * docs)
        taken += whole * size
        copies.append(whole)
    return group.assign(copies=copies)[["key", "size", "docs", "copies"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``m``: size (words), source_size, target and
    copies (0, 1 or 2).

    Null text has size 0; rows of size 0 keep one copy, which takes no words.  A null source
    is a source of its own.  In a class of equal source and size, the copies that do not go
    round fall on the rows with the smallest hash of id and text, so reruns agree; repeated rows
    share their hash and their fate.  Empty table: no rows.  Extra columns of
    any name stay in ``row``.

    One source's classes (its distinct sizes, not its rows) meet in one task.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = {"key": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")), "size": word_count(F.col(text_col)),
           "hash": F.xxhash64(F.col(id_col), F.col(text_col))}
    rows = docs.select(F.struct("*").alias("row"), F.struct(*[v.alias(k) for k, v in own.items()]).alias("m"))
    narrow = scratch.save(rows.select("m.*", F.col("row")[source_col].alias("source")), "rows")
    classes = scratch.save(narrow.groupBy("key", "size").agg(F.count("*").alias("docs"), F.first("source").alias("source")), "classes")
    sizes = classes.groupBy("key").agg(
        F.first("source").alias("source"), F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("all"))
    sources = source_targets(sizes.select("key", "source", "source_size")).join(sizes.select("key", "all"), "key")
    sources = scratch.save(sources.select(
        "key", "source_size", "target", F.greatest(F.col("source_size") / F.col("all"), F.lit(1.0)).alias("mean")), "sources")
    solved = solve(classes.drop("source"), sources, scratch)
    rated = classes.join(solved, "key").select("key", "size", "docs", _rate().alias("rate"))
    shared = scratch.save(rated.groupBy("key").applyInPandas(
        _whole_copies, "key string, size long, docs long, copies long"), "copies")
    shared = shared.select("key", "size", "docs", F.expr("copies div docs").alias("each"),
                           (F.col("copies") % F.col("docs")).alias("extra"))

    # the extra-th smallest hash of a class; large classes are ranked in buckets of the hash's range
    some = narrow.join(shared.where("extra > 0"), ["key", "size"]).select(
        "key", "size", "extra", "hash",
        F.floor((F.col("hash") / 2.0 ** 64 + 0.5) * F.ceil(F.col("docs") / RANK_ROWS)).alias("bucket"))
    counts = some.groupBy("key", "size", "bucket").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "size", "bucket", "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    here = (some.join(counts, ["key", "size", "bucket"]).where("before < extra and before + c >= extra")
            .withColumn("place", F.col("before") + F.row_number().over(
                Window.partitionBy("key", "size", "bucket").orderBy("hash"))))
    last = here.where("place = extra").select("key", "size", F.col("hash").alias("last"))
    plan = shared.join(last, ["key", "size"], "left").join(sources.select("key", "source_size", "target"), "key")
    plan = scratch.save(plan.select(*[F.col(c).alias(f"_{c}") for c in ("key", "size", "each", "last", "source_size", "target")]), "plan")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    copies = F.col("_each") + F.coalesce((F.col("m.hash") <= F.col("_last")).cast("long"), F.lit(0))
    return rows.join(plan, (F.col("m.key") == F.col("_key")) & (F.col("m.size") == F.col("_size"))).select(
        "row", F.struct(F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                                F.col("_target").alias("target"), copies.alias("copies")).alias("m"))
