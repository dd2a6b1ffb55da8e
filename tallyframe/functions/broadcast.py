"""Broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Return ``broadcast(df)`` when it has at most ``max_rows`` rows, else ``df``.

    The check reads at most ``max_rows + 1`` rows (``limit`` stops the scan early),
    so it is cheap even when the side turns out to be large; in that case the join
    falls back to a shuffle join and AQE re-plans it from measured sizes.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df

