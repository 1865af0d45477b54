"""Tabular sources, format dispatch and the choice of the text column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.text import as_text, quoted
from textcurate.operators.rowindex import tag_file_position
from textcurate.plans.scratch import materialize, path_exists
from textcurate.schema import BLOCK, FILE, LINE, PART, PLACE, SOURCE_POSITION, string_columns
from textcurate.sources.documents import read_docx, read_paged
from textcurate.sources.plaintext import read_plaintext
from textcurate.sources.spans import CSV, JSON_ARRAY, read_records

# Column names tried, in this order, when the requested text column is absent.
TEXT_COLUMN_NAMES = (
    "text", "content", "body", "title", "headline",
    "description", "summary", "message", "sentence", "query",
)

# Cells that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

SUPPORTED = ".csv, .json, .jsonl, .ndjson, .parquet, .txt, .md, .pdf, .docx"

# Types tried for a CSV column, narrowest first; a column takes the first type that fits all of its cells.
_CSV_TYPES = (
    ("boolean", r"^(true|True|TRUE|false|False|FALSE)$"),
    ("bigint", r"^\s*[+-]?\d+\s*$"),
    ("double", r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"),
)
# Integers of more digits than a double keeps; a column that has one is bigint if all its cells are, else string.
_LONG_INTEGER = r"^\s*[+-]?0*[1-9]\d{15,}\s*$"


# A line that is a record of its own: every quoted cell that opens in it closes in it.
_CELL = r'(?:"(?:[^"\r]++|"")*+"|[^",\r]*+)'
_WHOLE_RECORD = rf"^{_CELL}(?:,{_CELL})*+\r?$"
# How cells are written: a header row, and doubled quotes.
CSV_RULES = {"header": True, "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool | None = None
) -> DataFrame:
    """CSV with a header row and doubled quotes.

    Quoted cells may hold line breaks, and Spark itself cannot split a file that has such cells. A pass over the
    lines finds those that do; they are cut into records split by split (see :mod:`textcurate.sources.spans`), all others
    are read as lines. Only a file with carriage returns within its lines is read as a whole. ``multiline`` True or
    False leaves that pass out and reads all files as a whole, or all as lines. Without a ``schema`` another pass settles
    the column types.
    """
    reader = spark.read.options(**CSV_RULES)
    if schema is None:
        names = reader.option("multiLine", multiline is not False).option("inferSchema", False).csv(path).columns
        cell_schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    else:
        names, cell_schema = string_columns(schema), schema
    reader = reader.schema(cell_schema)

    def scan(whole: bool) -> DataFrame:
        return tag_file_position(reader.option("multiLine", whole).csv(path))

    def cut(files: str | list[str]) -> DataFrame:
        records = read_records(spark, files, CSV)
        record = F.regexp_replace("text", r"\r?\n$", "")
        records = records.filter(~F.col("opens")).select(FILE, BLOCK, record.alias("record")).filter("record <> ''")
        options = {"multiLine": "true", **{k: str(v).lower() for k, v in CSV_RULES.items()}, "header": "false"}
        # Any name may head a column; inside the parser they are numbers.
        plain = ", ".join(f"c{k} {field.dataType.simpleString()}" for k, field in enumerate(cell_schema.fields))
        parsed = records.select(F.from_csv("record", plain, options).alias("cells"), FILE, BLOCK)
        named = [F.col(f"cells.c{k}").alias(field.name) for k, field in enumerate(cell_schema.fields)]
        return parsed.select(*named, FILE, BLOCK)

    split: list[str] = []
    if multiline is not None:
        raw = scan(whole=multiline)
    else:
        lines = tag_file_position(spark.read.option("lineSep", "\n").text(path))
        broken = lines.filter(~F.col("value").rlike(_WHOLE_RECORD))
        found = broken.groupBy(FILE).agg(F.max(F.col("value").rlike(r"\r[\s\S]")).alias("returns"))
        # Names of files, which the scan lists on the driver as well.
        files = {r[0]: r["returns"] for r in found.collect()}
        split = [unquote(file) for file, returns in files.items() if not returns]
        raw = scan(whole=False)
        if files:
            raw = raw.filter(~F.col(FILE).isin(list(files)))
        if split:
            raw = raw.unionByName(cut(split))
        if len(split) < len(files):
            raw = raw.unionByName(scan(whole=True).filter(F.col(FILE).isin([f for f, r in files.items() if r])))
    cells = drop_na_tokens(raw, names)
    if schema is not None:
        return cells
    if split:
        # Cut and parsed once, for the types and for the caller.
        cells = materialize(cells, "cells")
    types = _fit_types(cells, names)
    return cells.select(*[quoted(n).cast(t).alias(n) for n, t in types], FILE, BLOCK)


def drop_na_tokens(df: DataFrame, names: list[str]) -> DataFrame:
    """Null for cells that mean "missing"."""
    return df.withColumns({n: F.when(~quoted(n).isin(*NA_TOKENS), quoted(n)) for n in names})


def _fit_types(cells: DataFrame, names: list[str]) -> list[tuple[str, str]]:
    checks = []
    for i, name in enumerate(names):
        checks.append(F.count(quoted(name)).alias(f"n{i}"))
        for kind, pattern in _CSV_TYPES:
            fits = quoted(name).rlike(pattern)
            if kind == "bigint":
                fits = fits & F.trim(quoted(name)).try_cast("bigint").isNotNull()
            elif kind == "double":
                fits = fits & ~quoted(name).rlike(_LONG_INTEGER)
            checks.append(F.count_if(fits).alias(f"{kind}{i}"))
    if not checks:
        return []
    seen = cells.agg(*checks).first()
    types = []
    for i, name in enumerate(names):
        fits = (kind for kind, _ in _CSV_TYPES if seen[f"{kind}{i}"] == seen[f"n{i}"])
        types.append((name, next(fits, "string") if seen[f"n{i}"] else "string"))
    return types


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST")
    return tag_file_position((reader if schema is None else reader.schema(schema)).json(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An array of records, or JSON lines; both are read in splits."""
    arrays, lines = _json_files(spark, path)
    if not arrays:
        return read_json_lines(spark, path, schema)
    cut = _read_json_arrays(spark, arrays, schema)
    if not lines:
        return cut
    return cut.unionByName(read_json_lines(spark, lines, schema), allowMissingColumns=True)


def _read_json_arrays(spark: SparkSession, files: list[str], schema: T.StructType | None) -> DataFrame:
    """The records of arrays, cut at the braces that end them."""
    record = F.regexp_replace("text", r"^[\s\uFEFF,\[]+", "")
    records = read_records(spark, files, JSON_ARRAY).select(FILE, BLOCK, record.alias("record"))
    # Behind the last record there is only the end of the array.
    records = records.filter(~F.col("record").rlike(r"^[\s\]}]*$"))
    if schema is None:
        strings = getattr(records.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        schema = DataFrame(spark._jsparkSession.read().option("mode", "FAILFAST").json(strings), spark).schema
    parsed = records.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("cells"), FILE, BLOCK)
    return parsed.select("cells.*", FILE, BLOCK)


def _json_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, first)``: the first character of each file that is not blank."""
    lines = tag_file_position(spark.read.text(path)).withColumn("line", F.monotonically_increasing_id())
    first = F.substring(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), 1, 1).alias("first")
    starts = lines.select(FILE, BLOCK, "line", first).filter("first <> ''")
    return starts.groupBy(FILE).agg(F.min_by("first", F.struct(BLOCK, "line")).alias("first"))


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files that hold an array, and those that hold lines. Every file is looked at, whatever the schema."""
    arrays: list[str] = []
    lines: list[str] = []
    for file, first in _json_starts(spark, path).collect():  # one row per file, as in Spark's own listing of them
        (arrays if first == "[" else lines).append(unquote(file))
    return arrays, lines


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    rows = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return tag_file_position(rows).withColumn(PLACE, F.col("_metadata.row_index"))


_TABLES = {
    ".csv": read_csv,
    ".jsonl": read_json_lines,
    ".ndjson": read_json_lines,
    ".json": read_json,
    ".parquet": read_parquet,
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tabular source as it stands: all rows, whatever their text."""
    if suffix_of(path) not in _TABLES:
        raise ValueError(f"cannot read files of type {suffix_of(path)!r} as tables; known types are {', '.join(_TABLES)}")
    return _TABLES[suffix_of(path)](spark, path)


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def choose_text_column(df: DataFrame, requested: str) -> str:
    """The requested column, else the first well-known name, else the string column with the longest mean text."""
    names = [c for c in df.columns if c not in SOURCE_POSITION]
    if requested in names:
        return requested
    for name in TEXT_COLUMN_NAMES:
        if name in names:
            return name
    candidates = [n for n in string_columns(df.schema) if n in names]
    if not candidates:
        raise KeyError(f"there is no column {requested!r} among {names}")
    if len(candidates) == 1:
        return candidates[0]
    # A missing cell counts with the three letters of "nan".
    lengths = df.agg(*[F.avg(F.length(F.coalesce(quoted(n), F.lit("nan")))) for n in candidates]).first()
    return max(zip(candidates, lengths), key=lambda pair: pair[1] or 0.0)[0]


@dataclass(frozen=True)
class Source:
    """Rows as read, the column that holds their text and, unless it is plain file order, the columns to sort by."""

    rows: DataFrame
    text_column: str
    order_by: list[str] | None = None


def read_dataset(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    schema: T.StructType | None = None,
    multiline: bool | None = None,
    extractor: Callable[[bytes], list[str]] | None = None,
) -> Source:
    """Read a file, folder or glob by its suffix, and keep the rows that have a text.

    ``extractor`` turns the bytes of one paged document into the texts of its pages.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"there is nothing to read at {path}")
    suffix = suffix_of(path)
    if suffix in (".txt", ".md"):
        return Source(read_plaintext(spark, path), "text", [FILE, BLOCK, PLACE, LINE])
    if suffix == ".docx":
        return Source(read_docx(spark, path), "text", [FILE, PART])
    if suffix == ".pdf":
        return Source(read_paged(spark, path, extractor), "text", [FILE, PART])
    if suffix not in _TABLES:
        raise ValueError(f"cannot read files of type {suffix!r}; known types are {SUPPORTED}")
    options = {"multiline": multiline} if suffix == ".csv" else {}
    df = _TABLES[suffix](spark, path, schema=schema, **options)
    chosen = choose_text_column(df, text_column)
    return Source(keep_text_rows(df, chosen), chosen)


def keep_text_rows(df: DataFrame, text_column: str) -> DataFrame:
    """Rows whose text is not null, with the text as a string. Empty strings stay."""
    dtype = df.schema[text_column].dataType
    return df.filter(quoted(text_column).isNotNull()).withColumn(text_column, as_text(quoted(text_column), dtype))
