"""Calendar spines: zero-filled periods between the first and last observed period.

The spine is generated from a one-row min/max aggregate with ``sequence`` +
``explode``; its size is the number of periods (months or days), not the number of
lines, so it is broadcast into the join with the per-period aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.cols import month_key_from_index


def month_spine(per_month: DataFrame, idx: str = "month_idx") -> DataFrame:
    """All month indexes from min(idx) to max(idx) of ``per_month``."""
    bounds = per_month.agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    return (bounds.filter(F.col("lo").isNotNull())
            .select(F.explode(F.sequence("lo", "hi")).alias(idx)))


def fill_months(per_month: DataFrame, value_cols: list[str], idx: str = "month_idx") -> DataFrame:
    """Left-join ``per_month`` onto its month spine, zero-filling ``value_cols``."""
    spine = month_spine(per_month, idx)
    out = F.broadcast(spine).join(per_month, idx, "left")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out.withColumn("month", month_key_from_index(F.col(idx)))


def fill_months_by(per_month: DataFrame, by: list[str], value_cols: list[str], idx: str = "month_idx") -> DataFrame:
    """Per group of ``by``: zero-filled months between the group's own first and last
    month. The spine has one row per (group, month); it is built from a per-group
    min/max and joined back on (group, month)."""
    if not by:
        return fill_months(per_month, value_cols, idx)
    bounds = per_month.groupBy(*by).agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    spine = bounds.select(*by, F.explode(F.sequence("lo", "hi")).alias(idx))
    out = spine.join(per_month, [*by, idx], "left")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out.withColumn("month", month_key_from_index(F.col(idx)))


def day_spine(per_day: DataFrame, day: str = "day") -> DataFrame:
    bounds = per_day.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return (bounds.filter(F.col("lo").isNotNull())
            .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(day)))


def fill_days(per_day: DataFrame, value_cols: list[str], day: str = "day") -> DataFrame:
    spine = day_spine(per_day, day)
    out = F.broadcast(spine).join(per_day, day, "left")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out
