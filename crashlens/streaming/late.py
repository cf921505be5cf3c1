"""Hourly rollup of a stream that closes hours and still loses no late row.

A watermark that only drops would lose reports.  Here each micro-batch is aggregated to cells (counts and a
mergeable user sketch), which are additive, and sorted by the watermark of the batches before it:

* ``open/batch_id=n``: all cells of hours that are still open, merged with those of the batch before; this is the
  whole state, bounded by the cells of the hours inside the watermark
* ``closed/batch_id=n``: cells of the hours that batch n closed, written once
* ``late/batch_id=n``: cells of rows that came for a closed hour, added on reading
* ``marks/batch_id=n``: greatest arrival time of batch n; written last, it commits the batch

Every folder is replaced as a whole when a batch is repeated, and readers take committed batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.functions.time import trunc_like
from crashlens.operators.moments import HOUR, hour_moments, spikes_by_hour, trailing_baseline
from crashlens.session import path_exists

CELL = ["app_name", "app_version", "platform", "hour"]
_MARKS = "last timestamp_ntz, batch_id long"
_MOMENTS = "app_name string, hour timestamp_ntz, n long, s long, s2 decimal(38,0), batch_id long"


def batch_cells(rows: DataFrame) -> DataFrame:
    """Cells of some rows: counts (``unique_users`` counts rows, as the original view does) and a user sketch."""
    rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return rows.groupBy("app_name", "app_version", "platform", trunc_like("hour", rows, "created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("crash_count"), F.count(F.lit(1)).alias("unique_users"),
        F.hll_sketch_agg("ip_hash").alias("users_sketch"))


def add_cells(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of partial cells by ``keys`` (default: the cell key), sketches united."""
    return cells.groupBy(*(keys or CELL)).agg(
        F.sum("crash_count").cast("long").alias("crash_count"), F.sum("unique_users").cast("long").alias("unique_users"),
        F.hll_union_agg("users_sketch").alias("users_sketch"))


def _closed(mark, delay_seconds: int) -> Column:
    """Hours whose end the watermark has passed (none before the first batch)."""
    if mark is None:
        return F.lit(False)
    return F.col("hour") + F.make_dt_interval(secs=F.lit(HOUR + delay_seconds)) <= F.lit(mark.isoformat()).cast("timestamp_ntz")


def _last_mark(spark: SparkSession, root: str, before: int | None = None):
    """(newest committed batch, greatest arrival time) up to batch ``before``; (None, None) without any."""
    if not path_exists(spark, f"{root}/marks"):
        return None, None
    marks = spark.read.schema(_MARKS).parquet(f"{root}/marks")
    if before is not None:
        marks = marks.where(F.col("batch_id") < before)
    return tuple(marks.agg(F.max("batch_id"), F.max("last")).first())


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Cells below ``path``, none if it has not been written."""
    schema = like.schema.add("batch_id", "long") if "batch_id" not in like.columns else like.schema
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def start_exact_rollup(accepted: DataFrame, root: str, checkpoint: str, delay_minutes: int = 10, available_now: bool = True,
                       on_close: Callable[[DataFrame, int], None] | None = None):
    """Roll a stream of accepted reports up below ``root``.  ``on_close`` gets the cells of the hours that a batch
    closed, and the batch's number."""
    root, delay = root.rstrip("/"), delay_minutes * 60

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, seen = _last_mark(spark, root, batch_id)
        cells = batch_cells(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            latest = batch.agg(F.max(F.col("created_at").cast("timestamp_ntz"))).first()[0]
            latest = max((t for t in (latest, seen) if t is not None), default=None)
            late = F.coalesce(_closed(seen, delay), F.lit(False))
            _put(cells.where(late), f"{root}/late", batch_id)
            state = _stored(spark, f"{root}/open", cells)
            state = state.where(F.col("batch_id") == (before if before is not None else -1)).drop("batch_id")
            known = add_cells(state.unionByName(cells.where(~late))).persist(StorageLevel.MEMORY_AND_DISK)
            done = F.coalesce(_closed(latest, delay), F.lit(False))
            _put(known.where(done), f"{root}/closed", batch_id)
            _put(known.where(~done), f"{root}/open", batch_id)
            if on_close is not None:
                on_close(known.where(done), batch_id)
            mark = spark.range(1).select(F.lit(latest.isoformat() if latest else None).cast("timestamp_ntz").alias("last"))
            _put(mark, f"{root}/marks", batch_id)
            _forget(spark, f"{root}/open", before)
            known.unpersist()
        finally:
            cells.unpersist()

    writer = accepted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _forget(spark: SparkSession, path: str, newest: int | None) -> None:
    """Delete states older than ``newest``, the one that a repeat of the current batch would read."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        number = status.getPath().getName().removeprefix("batch_id=")
        if newest is not None and number.isdigit() and int(number) < newest:
            fs.delete(status.getPath(), True)


def exact_rollup_parts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Committed cells by kind: ``closed``, ``late`` and ``open``."""
    root = root.rstrip("/")
    newest, _ = _last_mark(spark, root)
    newest = -1 if newest is None else newest
    like = batch_cells(spark.createDataFrame([], "app_name string, app_version string, platform string, "
                                             "created_at timestamp_ntz, ip_hash string"))
    parts = {k: _stored(spark, f"{root}/{k}", like) for k in ("closed", "late", "open")}
    committed = {k: v.where(F.col("batch_id") <= newest) for k, v in parts.items() if k != "open"}
    return {**committed, "open": parts["open"].where(F.col("batch_id") == newest)}


def read_exact_rollup(spark: SparkSession, root: str) -> DataFrame:
    """The rollup with every row in it: closed, late and open cells added up."""
    closed, late, still = exact_rollup_parts(spark, root).values()
    return add_cells(closed.unionByName(late).unionByName(still))


def users_by(rollup: DataFrame, *keys) -> DataFrame:
    """Estimated distinct users at any coarser grain, from the cells' sketches (relative standard
    error about 1.6 %; exact for few users)."""
    return rollup.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("users_sketch")).alias("users_estimate"),
                                     F.sum("crash_count").cast("long").alias("crashes"))


def hourly_alerts(root: str, k: float = 2.0, baseline_days: float = 7) -> Callable[[DataFrame, int], None]:
    """An ``on_close`` callback that judges each closed hour against its own trailing baseline (the rule
    of Q28 at that hour) and writes alerts below ``root``.

    Moments of closed hours are kept, one row an app and hour; a batch reads those of its hours' windows
    only and adds its own.
    """
    root = root.rstrip("/")

    def callback(cells: DataFrame, batch_id: int) -> None:
        spark = cells.sparkSession
        _put(hour_moments(cells), f"{root}/moments", batch_id)
        moments = spark.read.schema(_MOMENTS).parquet(f"{root}/moments").where(F.col("batch_id") <= batch_id).drop("batch_id")
        first = cells.agg(F.min("hour")).first()[0]
        if first is not None:
            span = F.make_dt_interval(secs=F.lit(int(baseline_days * 24 * HOUR)))
            moments = moments.where(F.col("hour") >= F.lit(first.isoformat()).cast("timestamp_ntz") - span)
        baseline = trailing_baseline(moments, baseline_days)
        _put(spikes_by_hour(cells, baseline, k), f"{root}/alerts", batch_id)

    return callback


__all__ = ["start_exact_rollup", "read_exact_rollup", "exact_rollup_parts", "users_by", "hourly_alerts"]
