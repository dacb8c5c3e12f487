"""Broadcasts of tables that a caller gives: only after a look at their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, with the hint to broadcast it if it has at most so many rows (they are counted no further); a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
