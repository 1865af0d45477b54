"""Sinks. A target is a folder of part files, written by all tasks at once."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textcurate.functions.text import plain_number, quoted
from textcurate.plans.scratch import shuffles_dropped
from textcurate.sources.readers import suffix_of

JSON_SUFFIXES = (".jsonl", ".ndjson", ".json")
# Sources that cannot be written back in their own format.
_DOCUMENT_SUFFIXES = (".txt", ".md", ".pdf", ".docx")


def default_target(source: str, label: str) -> str:
    """``data.csv`` -> ``data.kept.csv``; documents become JSON lines."""
    suffix = suffix_of(source)
    stem = source.rstrip("/")[: len(source.rstrip("/")) - len(PurePosixPath(source.rstrip("/")).suffix)]
    return f"{stem}.{label}{'.jsonl' if suffix in _DOCUMENT_SUFFIXES else suffix}"


def write_table(df: DataFrame, target: str, mode: str = "overwrite") -> int:
    """Write by the target's suffix and return the number of rows, counted while writing."""
    seen = Observation()
    with shuffles_dropped(df.sparkSession):
        _write(df.observe(seen, F.count(F.lit(1)).alias("rows")), target, mode)
    return int(seen.get["rows"])


def _write(counted: DataFrame, target: str, mode: str) -> None:
    suffix = suffix_of(target)
    if suffix == ".csv":
        # Without these options the writer trims cells and escapes quotes with backslashes.
        (
            counted.write.mode(mode)
            .option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(target)
        )
    elif suffix in JSON_SUFFIXES:
        cleaned = counted.select(*[plain_number(quoted(f.name), f.dataType).alias(f.name) for f in counted.schema.fields])
        cleaned.write.mode(mode).option("ignoreNullFields", False).json(target)
    elif suffix == ".parquet":
        counted.write.mode(mode).parquet(target)
    else:
        raise ValueError(f"cannot write files of type {suffix!r}")
