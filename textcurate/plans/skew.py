"""Joins against a table with one row per key, when some keys own a large share of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it owns more than 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE hot keys:
# that bounds both the list sent to the driver and the rows that are broadcast.
HOT_SHARE = 1000
# Below this many rows one key fits a task whatever its share.
HOT_MIN_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_MIN_ROWS, total: int | None = None) -> list:
    """Keys owning more than ``1/HOT_SHARE`` of ``df`` and at least ``min_rows`` rows; at most ``HOT_SHARE`` values."""
    total = df.count() if total is None else total
    if total < min_rows:
        return []
    hot = (F.col("_n") >= min_rows) & (F.col("_n") * HOT_SHARE > total)
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("_n")).filter(hot).select(key).collect()]


def join_on_unique(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    min_rows: int = HOT_MIN_ROWS,
    total: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per ``key``; ``how`` is ``inner`` or ``left``. ``total`` is the
    number of rows of ``left``, if that is known.

    Rows of hot keys never meet in one shuffle partition: their few right-hand rows are broadcast instead. All
    other rows take an ordinary equi-join. The two halves are disjoint, so their union is the whole join.
    """
    hot = hot_keys(left, key, min_rows, total)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold_part = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    hot_part = left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    return cold_part.unionByName(hot_part)
