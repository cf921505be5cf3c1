"""Admission guards that run before a body is parsed: per-client rate
limit (G1), payload size (G2) and signature (G3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashlens.functions.crypto import signature_ok
from crashlens.schema import MAX_PAYLOAD_CHARS, RATE_LIMIT_PER_MINUTE


def payload_ok(body: Column, max_chars: int = MAX_PAYLOAD_CHARS) -> Column:
    """Body length within ``max_chars`` (a NULL body counts as empty)."""
    return F.coalesce(F.length(body), F.lit(0)) <= max_chars


def signature_valid(body: Column, signature: Column, secret: str | None) -> Column:
    """HMAC-SHA256 of the raw body equals the (``sha256=``) header."""
    return signature_ok(body, signature, secret)


def rate_limit(df: DataFrame, *, key: str = "client_ip", ts: str = "arrived_at",
               tiebreak: str = "request_id", limit: int = RATE_LIMIT_PER_MINUTE,
               prior: DataFrame | None = None) -> DataFrame:
    """G1: fixed one-minute windows per client; the first ``limit`` requests
    of a (client, minute) pass, later ones get ``rate_limited = true`` and
    ``retry_after`` (seconds to the next window).

    ``prior`` (columns ``client_key, minute, admitted``) carries requests
    already admitted in earlier batches; a group then has ``limit -
    admitted`` places left.  This is how a stream continues its counts
    across micro-batches (``streaming.ledger_prior``).

    Exact and skew-safe: no task ever holds a whole (client, minute) group.

    1. Requests are ordered by time, then tie-break (NULLs last).  A group's cut-off is its
       request number ``quota``.  The ranked filter runs as a per-task top-``limit`` before the
       shuffle (WindowGroupLimit), so a flooding client sends at most ``limit + 1`` rows per map task.
    2. Only groups that reach the limit have a cut-off, and groups whose places
       are all taken come from ``prior``; both tables are small unless most
       clients flood, and AQE broadcasts them by measured size or splits a skewed join.
    3. Requests equal in time and tie-break that do not all fit are told apart by content, and
       equal rows by number (``_share_places``).  Nothing depends on where a row lies, so every
       evaluation of the plan decides alike.  One job over the ordering columns looks whether there are any.
    """
    no_time = F.timestamp_seconds(F.lit(0))  # window of requests without a time
    keyed = (df.withColumn("_rl_key", client_key(F.col(key)))
               .withColumn("_rl_minute", F.coalesce(F.date_trunc("minute", F.col(ts)), no_time))
               .withColumn("_rl_at", F.struct(F.col(ts).isNull().alias("no_ts"), F.col(ts).alias("ts"),
                                              F.col(tiebreak).isNull().alias("no_tb"), F.col(tiebreak).alias("tb"))))
    if limit <= 0:
        return _limited(keyed, F.lit(True), ts)
    groups = ["_rl_key", "_rl_minute"]
    in_order = Window.partitionBy(*groups).orderBy("_rl_at")
    ranked = (keyed.select(*groups, "_rl_at", F.row_number().over(in_order).alias("_rl_number"),
                           F.rank().over(in_order).alias("_rl_rank"))
                   .where(F.col("_rl_number") <= limit + 1))
    ranked = ranked.withColumn("_rl_next", F.lead("_rl_at").over(in_order))
    quota, full = F.lit(limit), None
    if prior is not None:
        used = prior.select(F.col("client_key").alias("_rl_key"),
                            F.coalesce(F.col("minute"), no_time).alias("_rl_minute"),
                            F.col("admitted").alias("_rl_used"))
        ranked = ranked.join(used, groups, "left")
        quota = F.lit(limit) - F.coalesce(F.col("_rl_used"), F.lit(0))
        full = used.where(F.col("_rl_used") >= limit).select(*groups, F.lit(True).alias("_rl_full"))
    cut = ranked.where(F.col("_rl_number") == quota).select(
        *groups, F.col("_rl_at").alias("_rl_cut"), (quota - F.col("_rl_rank") + 1).alias("_rl_places"),
        F.col("_rl_at").eqNullSafe(F.col("_rl_next")).alias("_rl_tied"))
    joined = keyed.join(cut, groups, "left")
    over = F.coalesce(F.col("_rl_at") > F.col("_rl_cut"), F.lit(False))
    if full is not None:
        joined = joined.join(full, groups, "left")
        over = F.coalesce(F.col("_rl_full"), F.lit(False)) | over
    ties = cut.where("_rl_tied")
    if ties.isEmpty():
        return _limited(joined, over, ts)
    shared = F.coalesce(F.col("_rl_tied") & F.col("_rl_at").eqNullSafe(F.col("_rl_cut")), F.lit(False))
    rest = _limited(joined.where(~shared), over, ts)
    ties = ties.select(*[F.col(c).alias(f"{c}_of") for c in groups], "_rl_cut", "_rl_places")
    met = keyed.join(ties, (F.col("_rl_key") == F.col("_rl_key_of")) & (F.col("_rl_minute") == F.col("_rl_minute_of"))
                     & F.col("_rl_at").eqNullSafe(F.col("_rl_cut")))
    tied = _share_places(met.drop("_rl_key_of", "_rl_minute_of", "_rl_cut"), df.columns, [*groups, "_rl_at"])
    return rest.unionByName(_limited(tied, F.col("_rl_over"), ts))


def _share_places(tied: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """``_rl_over`` for requests that tie at their group's cut-off, of which ``_rl_places`` pass.

    Equal rows are counted first (combined before the shuffle), contents are ordered by hash, and
    only the first ``_rl_places`` contents of a group are ranked; the copies of each then pass by number.
    """
    content = F.struct(F.xxhash64(*columns).alias("a"), F.hash(*columns).alias("b"))
    copies = (tied.groupBy(*columns, *groups, "_rl_places").agg(F.count(F.lit(1)).alias("_rl_copies"))
                  .withColumn("_rl_content", content))
    order = Window.partitionBy(*groups).orderBy("_rl_content")
    first = (copies.select(*groups, "_rl_content", "_rl_places", "_rl_copies", F.row_number().over(order).alias("_rl_number"))
                   .where(F.col("_rl_number") <= F.col("_rl_places")))
    before = F.sum("_rl_copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    passing = first.select(*[F.col(c).alias(f"{c}_of") for c in (*groups, "_rl_content")],
                           F.greatest(F.col("_rl_places") - F.coalesce(before, F.lit(0)), F.lit(0)).alias("_rl_passing"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*groups, "_rl_content")]
    out = copies.join(passing, same, "left")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rl_copies")))
    return out.select(*columns, *groups, F.coalesce(F.col("_rl_passing"), F.lit(0)).alias("_rl_passing"), number.alias("_rl_copy")
                      ).withColumn("_rl_over", F.col("_rl_copy") > F.col("_rl_passing"))


def _limited(df: DataFrame, over: Column, ts: str) -> DataFrame:
    """``rate_limited`` and ``retry_after`` from the decision, without the working columns."""
    retry = (F.lit(60) - (F.unix_seconds(F.col(ts).cast("timestamp")) % 60)).cast("int")
    out = (df.withColumn("rate_limited", over)
             .withColumn("retry_after", F.when(F.col("rate_limited"), retry)))
    return out.drop(*[c for c in out.columns if c.startswith("_rl_")])


def client_key(col: Column) -> Column:
    """Rate-limit key of a client address (a missing address is one client)."""
    return F.coalesce(col, F.lit("unknown"))
