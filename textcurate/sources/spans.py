"""Records that span lines, read in splits: quoted CSV cells with line breaks, and JSON arrays.

A file is read as units that end in a separator, which Spark does in splits. Where a record ends depends on all that stands
before it, but only through a mode (inside quotes or not) and a nesting depth. So each split first reports, for
either mode it may begin in, the mode it ends in and how it changes the depth; a scan over the splits of a file then
tells each its true beginning, and a second pass cuts records. A split keeps the records that begin and end in it. What is
left at its ends, a piece or two per split, is put together by the split in which the record begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.operators.rowindex import tag_file_position
from textcurate.plans.scratch import materialize
from textcurate.schema import BLOCK, FILE

_QUOTED = r'"(?:[^"]+|"")*+"'
_CSV_CELLS = re.compile(rf"(?:{_QUOTED}[^,]*|[^\",][^,]*|(?=,|$))(?:,(?:{_QUOTED}[^,]*|[^\",][^,]*|(?=,|$)))*+$", re.DOTALL)
_CSV_CLOSE = re.compile(r'(?:[^"]+|"")*+"[^,]*', re.DOTALL)
_JSON_TOKENS = re.compile(r'"(?:[^"\\]+|\\.)*+"|["{}\[\]]', re.DOTALL)
_JSON_CLOSE = re.compile(r'(?:[^"\\]+|\\.)*+"', re.DOTALL)


def csv_step(line: str, inside: int) -> tuple[int, int]:
    """Does a line, which begins inside quotes or not, end inside quotes? There is no depth."""
    if '"' not in line:
        return inside, 0
    if inside:
        close = _CSV_CLOSE.match(line)
        if not close:
            return 1, 0
        line = line[close.end() :]
        if not line:
            return 0, 0
        line = line[1:]  # the comma behind the cell
    return int(not _CSV_CELLS.match(line)), 0


def json_step(piece: str, inside: int) -> tuple[int, int]:
    """Does a piece of JSON end inside a string, and how does it change the depth?"""
    at = 0
    if inside:
        close = _JSON_CLOSE.match(piece)
        if not close:
            return 1, 0
        at = close.end()
    depth = 0
    for token in _JSON_TOKENS.findall(piece, at):
        if token == '"':
            return 1, depth
        if len(token) == 1:
            depth += 1 if token in "{[" else -1
    return 0, depth


@dataclass(frozen=True)
class Grammar:
    """Units end in ``separator``; a record ends behind a unit that leaves no quotes open at depth ``level``."""

    separator: str
    step: Callable[[str, int], tuple[int, int]]
    level: int


CSV = Grammar("\n", csv_step, 0)
JSON_ARRAY = Grammar("}", json_step, 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, list[str]]]:
    """Units by split, a batch or less at a time, with the first row of the run."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        values = columns.pop("value").to_pylist()
        files, blocks = np.asarray(columns[FILE].dictionary_encode().indices), np.asarray(columns[BLOCK])
        firsts = np.flatnonzero((np.diff(files, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0)).tolist()
        for first, last in zip(firsts, [*firsts[1:], batch.num_rows]):
            head = {name: column[first].as_py() for name, column in columns.items()}
            yield head[FILE], head[BLOCK], head, values[first:last]


def _reports(units: DataFrame, grammar: Grammar) -> DataFrame:
    """Per split, for either mode at its beginning: the mode at its end, the change of depth, and the least depth at which a
    unit ends outside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for file, block, _, values in _runs(batches):
            state = found.setdefault((file, block), [[mode, 0, None] for mode in (0, 1)])
            for value in values:
                piece = value + grammar.separator if grammar.level else value
                steps = {}
                for outcome in state:
                    mode = outcome[0]
                    if mode not in steps:
                        steps[mode] = grammar.step(piece, mode)
                    outcome[0], change = steps[mode]
                    outcome[1] += change
                    if not outcome[0] and (outcome[2] is None or outcome[1] < outcome[2]):
                        outcome[2] = outcome[1]
        for (file, block), (out, inside) in found.items():
            yield pa.RecordBatch.from_pylist([dict(zip(names, (file, block, *out, *inside)))], schema)

    names = [FILE, BLOCK, "end0", "change0", "least0", "end1", "change1", "least1"]
    schema = pa.schema([(FILE, pa.string()), *[(n, pa.int64()) for n in names[1:]]])
    return units.mapInArrow(run, f"{FILE} string, " + ", ".join(f"{n} bigint" for n in names[1:]))


def _beginnings(reports: DataFrame, level: int) -> DataFrame:
    """Per split its mode and depth at the beginning, and the split in which the record that is open there began."""

    def run(table: pa.Table) -> pa.Table:
        mode, depth, owner, out = 0, 0, None, []
        for row in sorted(table.to_pylist(), key=lambda r: r[BLOCK]):
            out.append({FILE: row[FILE], BLOCK: row[BLOCK], "mode": mode, "depth": depth, "owner": owner})
            least = row[f"least{mode}"]
            if owner is None or (least is not None and depth + least <= level):
                owner = row[BLOCK]
            mode, depth = row[f"end{mode}"], depth + row[f"change{mode}"]
        return pa.Table.from_pylist(out, schema)

    schema = pa.schema([(FILE, pa.string()), *[(n, pa.int64()) for n in (BLOCK, "mode", "depth", "owner")]])
    # One row per split.
    return reports.groupBy(FILE).applyInArrow(run, f"{FILE} string, {BLOCK} bigint, mode bigint, depth bigint, owner bigint")


def _cut(units: DataFrame, grammar: Grammar) -> DataFrame:
    """``(file, block, owner, at, text, opens)``: whole records (``owner`` is null) and pieces of records by their owner.

    ``opens`` marks the first record of a file, or the first piece of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, mode, depth, owner, parts, opens = None, 0, 0, None, [], False
        out: list = []

        def emit(to, text, first):
            out.append((split[0], split[1], to, split[1], text, first))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for file, block, head, values in _runs(batches):
            if (file, block) != split:
                if split and parts:
                    emit(split[1] if owner is None else owner, "".join(parts), opens)
                split, parts = (file, block), []
                mode, depth, owner = head["mode"], head["depth"], head["owner"]
                opens = owner is None
            for value in values:
                piece = value + grammar.separator
                mode, change = grammar.step(piece if grammar.level else value, mode)
                depth += change
                parts.append(piece)
                if not mode and depth <= grammar.level:
                    text = "".join(parts)
                    # In a file's first split nothing was open; elsewhere the first record to end belongs to an earlier split.
                    emit(None if owner is None or owner == block else owner, text, opens)
                    if owner is None or owner != block:
                        owner = block
                    # Blank records are none, so that the one behind them is still the first.
                    opens = opens and not text.strip()
                    parts = []
                if len(out) >= 1024:
                    yield flush()
                    out.clear()
        if split and parts:
            emit(split[1] if owner is None else owner, "".join(parts), opens)
        if out:
            yield flush()

    names = [FILE, BLOCK, "owner", "at", "text", "opens"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return units.mapInArrow(run, f"{FILE} string, {BLOCK} bigint, owner bigint, at bigint, text string, opens boolean")


def read_records(spark: SparkSession, paths: str | list[str], grammar: Grammar) -> DataFrame:
    """``(file, block, text, opens)``: records in file order, with their separators; ``opens`` marks the first of a file.

    Splits are those of Spark's text source, and so are their numbers: a record that spans splits stands between them.
    """
    units = tag_file_position(spark.read.option("lineSep", grammar.separator).text(paths)).select(FILE, BLOCK, "value")
    # Stored, so that the pass that finds them is not repeated whenever the records are looked at.
    starts = materialize(_beginnings(_reports(units, grammar), grammar.level), "beginnings")
    # One row per split, as in Spark's own list of them on the driver; the order of the units within a task stays.
    cut = _cut(units.join(F.broadcast(starts), [FILE, BLOCK]), grammar)
    whole = cut.filter("owner IS NULL").select(FILE, BLOCK, "text", "opens")
    pieces = cut.filter("owner IS NOT NULL").groupBy(FILE, "owner").agg(
        # A record's pieces, at most two or so per split.
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("pieces"),
        F.max("opens").alias("opens"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text")
    spanning = pieces.select(FILE, (F.col("owner") + 1).alias(BLOCK), text, "opens")
    return whole.unionByName(spanning)
