"""Curation decisions as an append-only table of edits ``(seq, _row_index, keep, flag, notes)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.functions.text import strip
from textcurate.schema import CURATION, ROW_INDEX

# Up to this many edits are broadcast; whoever writes rows puts them in order afterwards, so that only speed depends on it.
FEW_EDITS = 200_000
FIELDS = {"seq": "bigint", ROW_INDEX: "bigint", "keep": "boolean", "flag": "boolean", "notes": "string"}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())


class RowsOutOfRange(IndexError):
    """Edits name rows that the dataset does not have. ``rows`` holds them all, as a list or a DataFrame."""

    def __init__(self, size: int, count: int, rows: list[int] | DataFrame):
        named = f": {rows}" if isinstance(rows, list) else "; see .rows for all of them"
        super().__init__(f"{count} row indices are not within 0 and {size - 1}{named}")
        self.rows = rows


def make_edits(
    spark: SparkSession,
    row_indices: list[int],
    keep: bool | None = None,
    flag: bool | None = None,
    notes: str | None = None,
    seq: int = 0,
) -> DataFrame:
    """One edit for each listed row; a field left as ``None`` is not touched."""
    if keep is None and flag is None and notes is None:
        raise ValueError("nothing to mark: give keep, flag or notes a value")
    return spark.createDataFrame([(seq, int(i), keep, flag, notes) for i in row_indices], SCHEMA)


def out_of_range(edits: DataFrame, rows: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Edited row indices that a dataset of these rows, or of this size, does not have."""
    # Row indices are dense, so the row count is all that is needed of the dataset.
    index, size = F.col(ROW_INDEX), rows.count() if size is None else size
    return edits.select(ROW_INDEX).distinct().filter((index < 0) | (index >= size))


def latest(edits: DataFrame) -> DataFrame:
    """One row per edited row: for each field the last value set. Combined map-side, so a busy row is no hot spot."""
    last = [
        F.expr(f"max_by({f}, seq) FILTER (WHERE {f} IS NOT NULL)").alias(f"_{f}") for f in CURATION
    ]
    return edits.groupBy(ROW_INDEX).agg(*last)


def apply_edits(rows: DataFrame, edits: DataFrame, edit_count: int | None = None) -> DataFrame:
    """The rows with their latest keep, flag and notes.

    If the number of edits is known and small they are broadcast, and the rows are not moved.
    """
    last = latest(edits)
    if edit_count is not None and edit_count <= FEW_EDITS:
        last = F.broadcast(last)
    joined = rows.join(last, ROW_INDEX, "left")
    edited = joined.withColumns({f: F.coalesce(f"_{f}", f) for f in CURATION})
    return edited.select(*rows.columns)


def curation_counts(rows: DataFrame) -> DataFrame:
    """One row: how many rows there are, are kept, are flagged, and carry a note that is not blank."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if("keep").alias("kept_count"),
        F.count_if("flag").alias("flagged_count"),
        F.count_if(F.coalesce(strip(F.col("notes")), F.lit("")) != "").alias("noted_count"),
    )
