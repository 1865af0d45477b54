"""Two-dimensional coordinates for inspection: principal axes of the unit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.functions.vectors import matrix, project_to, unit_rows
from textcurate.schema import VECTOR

MIN_ROWS = 3
# Tasks that add up the moments of all others before one task adds up theirs.
ADDERS = 64
_MOMENTS = "n bigint, sums binary, products binary"


@dataclass(frozen=True)
class Axes:
    """Two directions as columns, and the place of the mean row along them. Places rows that it has not seen as well."""

    directions: np.ndarray
    center: np.ndarray

    def place(self, rows: DataFrame) -> DataFrame:
        """Add ``x`` and ``y``, centred on the rows that the axes were made of."""
        placed = rows.withColumn("_xy", project_to(F.col(VECTOR), self.directions))
        x, y = F.col("_xy")[0] - float(self.center[0]), F.col("_xy")[1] - float(self.center[1])
        return placed.withColumns({"x": x, "y": y}).drop("_xy")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row, to be read by :meth:`load`."""
        row = (self.directions.T.tolist(), self.center.tolist())
        spark.createDataFrame([row], "directions array<array<double>>, center array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Axes:
        row = spark.read.parquet(path).first()
        return cls(np.array(row.directions).T, np.array(row.center))


def _added(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    n, sums, products = 0, None, None
    for count, s, p in parts:
        n, sums, products = (count, s.copy(), p.copy()) if sums is None else (n + count, sums + s, products + p)
    if sums is not None:
        columns = [pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (sums, products))]
        yield pa.RecordBatch.from_arrays(columns, ["n", "sums", "products"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                units = unit_rows(matrix(batch.column(0).slice(at, 4096)))
                yield len(units), units.sum(axis=0), units.T @ units

    return _added(parts())


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for k in range(batch.num_rows):
                sums = np.frombuffer(batch.column(1)[k].as_buffer())
                yield batch.column(0)[k].as_py(), sums, np.frombuffer(batch.column(2)[k].as_buffer()).reshape(len(sums), -1)

    return _added(parts())


def principal_axes(rows: DataFrame) -> Axes:
    """The two directions of largest variance, from one pass over the vectors.

    Each task adds up the count, the sum and the products of its unit vectors; some tasks add up what these found, and
    one the rest, one matrix at a time, so that a matrix of vector length squared is all that any of them, and the
    driver, ever holds. The largest loading of each direction is positive, so that the picture is never mirrored.
    """
    found = rows.select(VECTOR).mapInArrow(_moments, _MOMENTS)
    spread = F.pmod(F.xxhash64("sums"), F.lit(ADDERS)).cast("int")
    found = found.repartitionById(ADDERS, spread).mapInArrow(_sum, _MOMENTS).repartition(1).mapInArrow(_sum, _MOMENTS)
    total = found.first()
    n = total.n if total else 0
    if n < MIN_ROWS:
        raise ValueError(f"a 2D projection needs at least {MIN_ROWS} rows, got {n}")
    mean = np.frombuffer(total.sums) / n
    if len(mean) < 2:
        raise ValueError(f"a 2D projection needs vectors of at least 2 dimensions, got {len(mean)}")
    covariance = np.frombuffer(total.products).reshape(len(mean), -1) / n - np.outer(mean, mean)
    directions = np.linalg.eigh(covariance)[1][:, ::-1][:, :2]
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(2)]
    directions = directions * np.where(largest < 0, -1.0, 1.0)
    return Axes(directions, mean @ directions)


def project_2d(rows: DataFrame) -> DataFrame:
    """Add ``x`` and ``y``, centred on zero."""
    return principal_axes(rows).place(rows)


def coordinate_range(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
    )
