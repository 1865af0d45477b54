"""Looking at rows: lookup, previews, kept rows, the scatter frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcurate.functions.text import as_text, quoted, snippet
from textcurate.schema import COORDINATES, INTERNAL, ROW_INDEX, VECTOR

# Columns that colour a scatter plot, best first.
COLOR_COLUMNS = ("source", "label", "category", "class", "flag", "keep")


def get_rows(rows: DataFrame, wanted: DataFrame | list[int], coordinates: tuple[str, ...] = COORDINATES) -> DataFrame:
    """Full rows by index; ``wanted`` is a list or a table with ``_row_index``. Vectors and coordinates are left out."""
    if isinstance(wanted, list):
        found = rows.filter(F.col(ROW_INDEX).isin(wanted))
    else:
        found = rows.join(wanted.select(ROW_INDEX), ROW_INDEX, "left_semi")
    plain = [c for c in found.columns if c not in INTERNAL and c not in coordinates]
    return found.select(F.col(ROW_INDEX).alias("row_index"), *[quoted(c) for c in plain])


def preview_columns(text_column: str, id_column: str | None = None) -> list[Column]:
    columns = [
        F.col(ROW_INDEX).alias("row_index"),
        snippet(quoted(text_column)).alias(text_column),
        F.col("keep"),
        F.col("flag"),
    ]
    if id_column and id_column not in (text_column, "keep", "flag"):
        columns.append(quoted(id_column))
    return columns


def preview(
    rows: DataFrame, text_column: str, id_column: str | None = None, extra: list[str] | None = None
) -> DataFrame:
    """Compact rows: index, start of the text, keep, flag, the id if there is one, and any ``extra`` columns."""
    known = id_column if id_column in rows.columns else None
    return rows.select(*preview_columns(text_column, known), *[quoted(c) for c in extra or []])


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("keep")


def color_column(rows: DataFrame) -> str | None:
    return next((c for c in COLOR_COLUMNS if c in rows.columns), None)


def scatter_frame(rows: DataFrame, text_column: str) -> DataFrame:
    """What a scatter plot of projected rows shows: position, colour, snippet and vector."""
    name = color_column(rows)
    color = as_text(quoted(name), rows.schema[name].dataType) if name else F.lit(None).cast("string")
    return rows.select(
        F.col(ROW_INDEX).alias("row_index"),
        "x",
        "y",
        color.alias("color"),
        snippet(quoted(text_column)).alias("snippet"),
        F.col(VECTOR).alias("embedding"),
    )
