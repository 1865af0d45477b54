"""String and scalar column functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET_CHARS = 240

# Punctuation replaced before a text goes to the model.
ASCII_PUNCTUATION = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "-",
    "…": "...",
    "•": "*",
    "·": ".",
    " ": " ",
    "→": "->",
    "←": "<-",
    "«": '"',
    "»": '"',
    "‹": "'",
    "›": "'",
    "®": "(R)",
    "©": "(c)",
}

# Spellings that count as true.
TRUE_WORDS = ("true", "1", "yes", "y", "t", "keep")

# All white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(text: Column) -> Column:
    """Remove white space of every kind, line breaks included, from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalize_string(text: str) -> str:
    """What the model sees of one text: compatibility form, then plain punctuation."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    for mark, plain in ASCII_PUNCTUATION.items():
        text = text.replace(mark, plain)
    return text


@F.arrow_udf(T.StringType())
def _normalize_udf(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalize_string(t) for t in texts.to_pylist()], pa.string())


def normalize_text(text: Column) -> Column:
    """Column form of :func:`normalize_string`. NFKC has no built-in, so texts beyond ASCII, and no others, go through
    Arrow batches. ``text`` is looked at more than once, so let it be a column and not a long expression."""
    return F.coalesce(_normalize_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def cache_key(model: str, text: Column) -> Column:
    """SHA-256, in hex, of the model name, a zero byte and the raw text."""
    return F.sha2(F.concat(F.lit(model), F.lit("\u0000"), text), 256)


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """The text itself, or its beginning and an ellipsis, ``chars`` characters in all."""
    shortened = F.concat(F.substring(text, 1, chars - 1), F.lit("…"))
    return F.when(F.length(text) <= chars, text).otherwise(shortened)


def coerce_bool(value: Column, dtype: T.DataType, if_null: bool = True) -> Column:
    """Read booleans, numbers and the words an editor leaves behind as a boolean, never null."""
    if isinstance(dtype, T.BooleanType):
        truth = value
    elif isinstance(dtype, T.NumericType):
        truth = value != 0
    else:
        truth = F.lower(strip(value.cast("string"))).isin(*TRUE_WORDS)
    return F.coalesce(truth, F.lit(if_null))


def as_text(value: Column, dtype: T.DataType) -> Column:
    """Cast to string; booleans read ``True`` and ``False``."""
    text = value.cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def plain_number(value: Column, dtype: T.DataType) -> Column:
    """Floating-point NaN as null; everything else unchanged."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(value, F.lit(None).cast(dtype))
    return value


def row_json(schema: T.StructType, names: list[str] | None = None) -> Column:
    """One row as a JSON object in which missing and NaN values are written as null."""
    fields = [f for f in schema.fields if names is None or f.name in names]
    values = [plain_number(quoted(f.name), f.dataType).alias(f.name) for f in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
