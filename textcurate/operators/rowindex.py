"""Dense, 0-based row positions without a global sort of file data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from textcurate.plans.scratch import materialize
from textcurate.schema import BLOCK, FILE, PLACE, ROW_INDEX, SOURCE_POSITION

_POS, _RUN, _TASK = "__pos", "__run", "__task"
# One offset row per file split or per range partition. Up to this many are broadcast; more are joined by shuffle.
MAX_BROADCAST_RUNS = 1_000_000


def tag_file_position(df: DataFrame) -> DataFrame:
    """Note the file split each row came from; only valid directly above a file scan."""
    return df.withColumns({FILE: F.col("_metadata.file_path"), BLOCK: F.col("_metadata.file_block_start")})


@dataclass(frozen=True)
class _Runs:
    """Runs of consecutive rows: one row ``(*key, _n, _first)`` per file, split or partition, never per data row."""

    table: DataFrame
    key: list[str]
    count: int
    gaps: bool

    def shifts(self) -> DataFrame:
        """What to add to a row's position to get its index, per run."""
        before = Window.orderBy(*self.key).rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
        shifts = self.table.select(*self.key, start.alias("_shift"))
        return F.broadcast(shifts) if self.count <= MAX_BROADCAST_RUNS else shifts


def _find_runs(placed: DataFrame, key: list[str], position: str) -> _Runs:
    table = placed.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first"), F.max(position).alias("_last")
    )
    seen = Observation()
    gaps = F.count_if(F.col("_last") >= F.col("_n")).alias("gaps")
    table = materialize(table.observe(seen, F.count(F.lit(1)).alias("runs"), gaps), "row-runs")
    return _Runs(table, key, seen.get["runs"], seen.get["gaps"] > 0)


def with_row_index(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Append ``_row_index``: 0..N-1 in file order, or in the order of the given (unique) columns.

    File order needs :func:`tag_file_position` and moves no data: every split is a run of consecutive rows, so a
    row's index is its place in the run plus the number of rows in earlier runs. Parquet knows the place of a row in
    its file; as long as no row of a file is left out, that is all there is to do. In other cases rows are written
    once, because a place counted by a task must not change if the task is run again. An explicit order costs one
    range exchange.
    """
    runs, position, placed = None, PLACE, df
    if PLACE in df.columns and not order_by:
        runs = _find_runs(df, [FILE], PLACE)
    if runs is None or runs.gaps:
        # Rows of a split that were stored meanwhile may be read by several tasks, in their order.
        key, position = [_RUN] if order_by else [FILE, BLOCK, _TASK], _POS
        if order_by:
            placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
            placed = placed.withColumn(_RUN, F.spark_partition_id())
        else:
            placed = placed.withColumn(_TASK, F.spark_partition_id())
        placed = materialize(placed.withColumn(_POS, F.monotonically_increasing_id()), "rows")
        runs = _find_runs(placed, key, _POS)
    indexed = placed.join(runs.shifts(), runs.key).withColumn(ROW_INDEX, F.col(position) + F.col("_shift"))
    return indexed.drop(_RUN, _TASK, _POS, "_shift", *SOURCE_POSITION)
