"""Global prefix sums: one range partitioning, per-partition totals, local sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crashlens.llm.scratch import Scratch


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``position`` (0-based place in ``order``) and, for each
    ``sums`` entry {column: new column}, the sum of the column over all rows before and
    (as ``{new}_total``) over all rows.

    Rows are dealt by ranges of ``order`` and stored with their range number, so
    that totals and rows share the same ranges.  Only the totals, one row a range,
    meet in one task; they are broadcast, being bounded by the number of ranges.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    stored = scratch.save(ranged, name)
    totals = stored.groupBy("_range").agg(
        F.count("*").alias("_rows"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_all_{c}").over(Window.partitionBy()).alias(f"{new}_total") for c, new in sums.items()])
    here = Window.partitionBy("_range").orderBy(*order)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    out = stored.join(F.broadcast(starts), "_range")
    return out.select(
        *df.columns, (F.col("_rows_before") + F.row_number().over(here) - 1).alias("position"),
        *[f"{new}_total" for new in sums.values()], *[(F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).cast("long").alias(new)
          for c, new in sums.items()])
