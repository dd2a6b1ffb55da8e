"""Global row numbers and running sums without a one-task window.

Rows are range-partitioned by the order and written with the number of their partition;
then a window within each partition and one offset per partition give global positions.
Equal rows may change places, which no caller can see. Only the offsets table (one row per
partition and group) meets in one place, and as a window over it, not on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.store import keep, tasks


def running(df: DataFrame, order: list[Column], value: str, out: str, by: str | None = None,
            total: str | None = None) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` (a long, not null) over all rows before this
    one in ``order``, within the same ``by`` (null is a group). Values of ``1`` make a row
    number from 0. ``by`` may hold any share of the rows: the ranges split it. ``total``
    names a further column for the sum over all rows (of the same ``by``)."""
    spark = df.sparkSession
    group = [F.col(by).asc_nulls_last()] if by else []
    parts = keep(df.repartitionByRange(tasks(spark), *group, *order)
                 .withColumn("_part", F.spark_partition_id()), "ordered")
    keys = ["_part", by] if by else ["_part"]
    totals = parts.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*([by] if by else [])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_total").over(W.partitionBy(*([by] if by else []))))
    offsets = offsets.drop("_total")
    own = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = parts.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    offsets = offsets.withColumnRenamed("_part", "_opart")
    on = F.col("_part") == F.col("_opart")
    if by:
        offsets = offsets.withColumnRenamed(by, "_oby")
        on = on & F.col(by).eqNullSafe(F.col("_oby"))
    return (local.join(offsets, on).withColumn(out, F.col("_own") + F.col("_offset"))
            .drop("_part", "_opart", "_oby", "_own", "_offset"))
