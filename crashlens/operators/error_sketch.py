"""Most frequent error texts from mergeable sketches.

Every arrival date stores one frequent-items sketch of its error prefixes.  Sketches of any dates combine into one, whose
tracked items are the only candidates for the top: an item that is not tracked has at most
``ERROR_SHARE / map size`` of all rows.  A second pass counts just the candidates exactly.  If the last
winner's exact count does not exceed that bound, the answer is not proven and all prefixes are counted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.functions.text import left
from crashlens.plans.basic import top_errors
from crashlens.session import overwrite_partitions

#: A-priori error of a frequent-items sketch: this share of the weight, divided by its map size.
ERROR_SHARE = 3.5
TRACKED = 4096
_SCHEMA = ("messages long, sketch struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>, "
           "created_date date")


def map_size(tracked: int) -> int:
    """Entries of the map behind a sketch that tracks ``tracked`` items (load factor 3/4, a power of two)."""
    return 1 << math.ceil(math.log2(math.ceil(tracked / 0.75)))


def update_error_sketches(facts: DataFrame, path: str, dates=None, width: int = 100, tracked: int = TRACKED) -> None:
    """Rebuild the sketches of ``dates`` (None: all): ``created_date, messages, sketch``, one row a date."""
    if dates is not None:
        facts = facts.where(F.col("created_date").isin(*[F.lit(d).cast("date") for d in dates]))
    prefix = left(F.col("error_message"), width)
    rows = facts.where(F.col("error_message").isNotNull()).select("created_date", prefix.alias("prefix"))
    daily = rows.groupBy("created_date").agg(
        F.count(F.lit(1)).alias("messages"), F.expr(f"approx_top_k_accumulate(prefix, {int(tracked)})").alias("sketch"))
    overwrite_partitions(daily, "created_date").parquet(path)


def read_error_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


@dataclass(frozen=True)
class TopErrors:
    """Result of ``top_errors_from_sketches``: its rows and how they were found."""

    rows: DataFrame
    candidates: int
    bound: float
    proven: bool


def top_errors_from_sketches(facts: DataFrame, sketches: DataFrame, n: int = 20, width: int = 100,
                             tracked: int = TRACKED, since_date=None) -> TopErrors:
    """Q08: the ``n`` most frequent prefixes with count, distinct users and apps, over all dates or those from
    ``since_date`` on.

    At most ``tracked`` candidates and ``n`` winners pass through the driver; rows of other prefixes are dropped
    by a broadcast of these before anything is shuffled.  Falls back to a full count if the sketches
    cannot prove the winners.
    """
    if since_date is not None:
        facts = facts.where(F.col("created_date") >= F.lit(since_date).cast("date"))
        sketches = sketches.where(F.col("created_date") >= F.lit(since_date).cast("date"))
    spark, prefix = facts.sparkSession, left(F.col("error_message"), width)
    messages = sketches.agg(F.sum("messages")).first()[0] or 0
    if not messages:
        return TopErrors(top_errors(facts.limit(0), n, width), 0, 0.0, True)
    items = sketches.select(F.expr(f"approx_top_k_combine(sketch, {int(tracked)})").alias("sketch")).select(
        F.expr(f"approx_top_k_estimate(sketch, {int(tracked)})").alias("items")).first()["items"]
    candidates = [x["item"] for x in items]
    bound = ERROR_SHARE * messages / map_size(tracked)
    named = facts.where(F.col("error_message").isNotNull()).withColumn("error_preview", prefix)

    def only(items):
        chosen = spark.createDataFrame([(x,) for x in items], "error_preview string")
        return named.join(F.broadcast(chosen), "error_preview", "left_semi")

    counts = only(candidates).groupBy("error_preview").agg(F.count(F.lit(1)).alias("frequency"))
    counts = counts.select("*", F.sum("frequency").over(Window.partitionBy()).alias("covered"))  # as many rows as candidates
    best = counts.orderBy(F.desc("frequency"), "error_preview").limit(n).collect()
    complete = bool(best) and best[0]["covered"] == messages  # no other prefix exists
    proven = complete or (len(best) == n and best[-1]["frequency"] > bound)
    if not proven:
        return TopErrors(top_errors(facts, n, width), len(candidates), bound, False)
    rows = top_errors(only([r["error_preview"] for r in best]).drop("error_preview"), n, width)
    return TopErrors(rows, len(candidates), bound, True)
