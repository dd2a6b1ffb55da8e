"""Top-k and global running sums without funnelling rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int | None, by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows per group of ``by`` in ``order`` (a total order: end with the key).

    Without ``by`` this is ``orderBy(...).limit(k)``, which Spark plans as
    TakeOrderedAndProject: every task keeps its own k best, only k·tasks rows move.
    With ``by`` it is ``row_number() <= k`` over ``partitionBy(by)``; callers apply it
    after aggregating, so a group holds entities, not lines.
    """
    if k is None:
        return df
    if not by:
        return df.orderBy(*order).limit(int(k))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _pinned(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` (reliably, to the shared checkpoint folder) so that every
    later read sees the same range partitions.

    The per-range totals and the rows themselves are two reads of the ranged
    frame; without a single materialized copy their agreement would rest on Spark
    reusing the same exchange (range bounds are sampled per exchange).
    """
    from tallyframe.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_running(df: DataFrame, order: Sequence[Column], value: str,
                   partitions: int | None = None) -> DataFrame:
    """Add ``_pos`` (1-based position in ``order``) and ``_cum`` (running Σ value).

    A window with ORDER BY and no PARTITION BY moves every row into one task. Here
    the rows are range-partitioned on the order (balanced by sampling), running sums
    are taken per range, and each range is shifted by the totals of the ranges before
    it — a table with one row per range, broadcast back. ``order`` must be a total
    order so that ties cannot straddle ranges ambiguously. The ranged frame is
    checkpointed once (see ``_pinned``), so the result does not depend on exchange
    reuse. This runs a job when called.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order)
    local = _pinned(ranged
                    .withColumn("_lpos", F.row_number().over(w))
                    .withColumn("_lcum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    totals = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(wp), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_s").over(wp), F.lit(0)).alias("_off_s"))
    out = local.join(F.broadcast(offsets), "_pid")
    return (out.withColumn("_pos", F.col("_lpos") + F.col("_off_n"))
               .withColumn("_cum", F.col("_lcum") + F.col("_off_s"))
               .drop("_pid", "_lpos", "_lcum", "_off_n", "_off_s"))


def global_lag(df: DataFrame, order: Sequence[Column], cols: Sequence[str],
               partitions: int | None = None) -> DataFrame:
    """Add ``_prev_<c>`` for each of ``cols``: the value on the previous row in the
    total ``order`` (null on the first row).

    Rows are range-partitioned on the order (a hot key's rows spread over several
    ranges), lagged within each range, and the first row of each range takes the
    last row of the previous non-empty range from a one-row-per-range table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order)
    local = ranged.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        local = local.withColumn(f"_lp_{c}", F.lag(c).over(w))
    local = _pinned(local)
    lasts = local.groupBy("_pid").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), "_rn").alias("_last"))
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    prev_last = lasts.select("_pid", F.last("_last", ignorenulls=True).over(wp).alias("_pl"))
    out = local.join(F.broadcast(prev_last), "_pid", "left")
    for c in cols:
        out = out.withColumn(f"_prev_{c}", F.when(F.col("_rn") == 1, F.col("_pl")[c]).otherwise(F.col(f"_lp_{c}")))
    return out.drop("_pid", "_rn", "_pl", *[f"_lp_{c}" for c in cols])
