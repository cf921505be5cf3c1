"""Chat rendering of maximal conversations.

Chat logs often hold cumulative snapshots: each request repeats the turns before.  A
conversation that is a prefix of a longer one says nothing new and is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch

TEMPLATE = ("<|im_start|>", "<|im_end|>\n")


def prefix_hashes(turns: DataFrame, block: int = 1024) -> DataFrame:
    """(conv, place, role, text, a, b): turns in order with rolling 128-bit hashes of the prefix
    that ends there.

    A prefix's hash is the xor of the hashes of (place, role, text) over its turns, so it
    can be summed in blocks: a conversation of any length is spread over many tasks.
    """
    turns = turns.select("conv", "turn", "role", "text").distinct()
    turns = turns.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv", "block").agg(F.count("*").alias("c"))
    counts = counts.select("conv", "block", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))

    def with_blocks(df: DataFrame, side: DataFrame) -> DataFrame:
        side = side.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"),
                           *[c for c in side.columns if c not in ("conv", "block")])
        return df.join(side, df["conv"].eqNullSafe(side["_conv"]) & (df["block"] == side["_block"])).drop("_conv", "_block")

    placed = with_blocks(turns.withColumn("row", F.row_number().over(inside)), counts)
    placed = placed.select("conv", "block", "role", "text", (F.col("before") + F.col("row") - 1).alias("place"))
    placed = placed.withColumns({"ha": F.xxhash64("place", "role", "text", F.col("role").isNull(), F.col("text").isNull()),
                                 "hb": F.xxhash64(F.lit("turn"), "text", "role", "place", F.col("role").isNull())})
    rolling = Window.partitionBy("conv", "block").orderBy("place")
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    sums = sums.select("conv", "block", F.coalesce(F.bit_xor("xa").over(earlier), F.lit(0)).alias("ea"),
                       F.coalesce(F.bit_xor("xb").over(earlier), F.lit(0)).alias("eb"))
    local = placed.select("conv", "block", "place", "role", "text", F.bit_xor("ha").over(rolling).alias("la"),
                          F.bit_xor("hb").over(rolling).alias("lb"))
    return with_blocks(local, sums).select(
        "conv", "place", "role", "text", F.col("ea").bitwiseXOR(F.col("la")).alias("a"),
        F.col("eb").bitwiseXOR(F.col("lb")).alias("b"))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv, n_turns) of conversations that no longer one, and no equal one of a smaller id, starts with."""
    last = hashed.groupBy("conv").agg(F.max(F.struct("place", "a", "b")).alias("end"))
    ends = last.select("conv", (F.col("end.place") + 1).alias("n"), "end.a", "end.b")
    length = ends.select(F.col("conv").alias("_conv"), F.col("n").alias("owner_n"))
    keys = ends.select(F.col("a").alias("ka"), F.col("b").alias("kb")).distinct()
    # only prefixes that are some conversation's whole; then the longest owner, least id first
    met = hashed.select("conv", "a", "b").join(keys, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left_semi")
    owners = met.join(length, met["conv"].eqNullSafe(length["_conv"]))
    best = owners.groupBy("a", "b").agg(F.min(F.struct(
        (-F.col("owner_n")).alias("n"), F.col("conv").isNull().alias("none"), "conv")).alias("best"))
    best = best.select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("best.conv").alias("owner"))
    beaten = (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")) & ~F.col("conv").eqNullSafe(F.col("owner"))
    return ends.join(best, beaten, "left_anti").select("conv", F.col("n").alias("n_turns"))


def render_chats(turns: DataFrame, part_turns: int = 512, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Chat text of the maximal conversations: id, n_turns, part, rendered.

    Turns are ordered by turn, role, text (nulls first); repeated rows count once.  A
    conversation of over ``part_turns`` turns is rendered in parts of that many, numbered
    from 0.  A null role or text is rendered empty.  Rows with a null id are one conversation.
    Empty table: no rows.  Other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "chats")
    base = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.col(text_col).alias("text"))
    hashed = scratch.save(prefix_hashes(base), "turns")
    kept = scratch.save(maximal(hashed), "maximal").withColumnRenamed("conv", "_conv")
    before, after = TEMPLATE
    piece = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(after))
    rows = hashed.join(kept, hashed["conv"].eqNullSafe(kept["_conv"])).select(
        "conv", "n_turns", F.expr(f"place div {part_turns}").alias("part"), F.struct("place", piece.alias("piece")).alias("p"))
    whole = rows.groupBy("conv", "part").agg(F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select(F.col("conv").alias(id_col), "n_turns", "part", F.array_join("ps.piece", "").alias("rendered"))
