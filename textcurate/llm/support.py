"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_states: dict = {}


def file_bytes(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file, sent to the executors: a few MB whatever the data."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def once(key: tuple, build: Callable):
    """What ``build`` returned the first time in this process; later tasks of a Python worker find it ready.

    One result is kept: a worker that goes on to another operator does not carry the tables of the last.
    """
    if key not in _states:
        forget()
        _states[key] = build()
    return _states[key]


def forget() -> None:
    """For operators that keep nothing between tasks."""
    _states.clear()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
