"""Reserved column names and the three curation columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.text import coerce_bool, quoted

ROW_INDEX = "_row_index"
VECTOR = "_embedding"
KEY = "_key"
# Where a row stood in its source; gone once the row index is made.
FILE, BLOCK, PLACE, LINE, PART = "__file", "__block", "__place", "__line", "__part"
SOURCE_POSITION = (FILE, BLOCK, PLACE, LINE, PART)
# Columns the package makes for itself; no output file contains them.
INTERNAL = (ROW_INDEX, VECTOR, KEY)
COORDINATES = ("x", "y")
CURATION = ("keep", "flag", "notes")


def ensure_curation_columns(df: DataFrame) -> DataFrame:
    """Add ``keep``/``flag``/``notes`` where absent; bring existing ones to boolean, boolean and string."""
    present = {f.name: f.dataType for f in df.schema.fields}
    keep = coerce_bool(F.col("keep"), present["keep"], if_null=True) if "keep" in present else F.lit(True)
    flag = coerce_bool(F.col("flag"), present["flag"], if_null=False) if "flag" in present else F.lit(False)
    notes = F.coalesce(F.col("notes").cast("string"), F.lit("")) if "notes" in present else F.lit("")
    return df.withColumns({"keep": keep, "flag": flag, "notes": notes})


def drop_internal(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*INTERNAL, *also)


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in INTERNAL]


def string_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


def select_quoted(names: list[str]) -> list:
    return [quoted(n) for n in names]
