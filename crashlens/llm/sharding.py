"""Balanced contiguous shards by global byte prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashlens.llm.order import prefix_sums
from crashlens.llm.scratch import Scratch


def byte_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut the rows, in order of ``id_col``, into ``n_shards`` runs of near equal bytes.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1).  With S the sum
    of all sizes, a row that starts at byte s belongs to shard
    floor((s + size / 2) * n_shards / S): shards differ by no more than the largest
    rows at their cuts.  ``slot`` counts from 0 in each shard without gaps.

    Only id, size, checksum and the ``carry`` columns move; texts stay where they
    are.  Ties in the id (repeated rows, null ids, which come first) are ordered by
    checksum and size; rows alike in all three are interchangeable.  A row larger
    than a share can leave shards empty.  An empty table gives no rows.  Output:
    id, size, text_crc32, law, shard, slot, grown_shard and, if any are
    named, ``row`` (a struct of the ``carry`` columns); other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"), *([F.struct(*carry).alias("row")] if carry else []))
    placed = prefix_sums(rows, ["_id", "_crc", "_size"], {"_size": "_start"}, scratch, "rows")
    cut = placed.withColumn("_shard", F.expr(f"(2 * _start + _size) * {n_shards} div (2 * _start_total)").cast("int"))
    cut = scratch.save(cut.drop("_start_total"), "cut")
    firsts = cut.groupBy("_shard").agg(F.min("position").alias("_first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "_shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
        (F.col("position") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))
