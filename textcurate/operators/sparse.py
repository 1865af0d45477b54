"""Near-duplicate pairs of sparse vectors by an inverted index. Every answer is exact.

Dimensions are ordered by how many vectors use them, rarest first. A vector is posted under its first dimensions only,
as long as what is left of it is no shorter than the threshold: two vectors whose product reaches the threshold meet under
the first dimension that they share, since all that lies behind it could not reach it for either if it were not posted.
A posting knows its weight there and the length of the rest behind it, so that the product is at most the product of
the weights plus that of the rests. Vectors travel in blocks, once for a group of blocks that they are compared with, and never
once for a posting. Beyond a few blocks they are those of :mod:`textcurate.operators.blocks`: of two blocks that are too far apart for
the threshold neither travels to the other. A task derives the postings of its blocks, finds the pairs that share a list, bounds their products run by
run of dimensions and by the first list that they share, and verifies the few that are left on whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.functions.vectors import RANK_DECIMALS, matrix, ranked, unit_rows
from textcurate.operators import blocks
from textcurate.operators.blocks import SLACK
from textcurate.operators.similarity import DIRECT_BLOCKS, _best_pairs, _distinct_vectors, _is_zero, _pair_table
from textcurate.plans.scratch import materialize

# Runs of dimensions whose lengths bound a product.
SEGMENTS = 64
BLOCK_ROWS = 1024
_PAIRS_AT_ONCE = 1 << 13
_SLACK = 1e-9
_PAIRS = "a bigint, b bigint, similarity double"
_CANDIDATES = "a bigint, b bigint, dimension int"


def _order(points: DataFrame) -> np.ndarray:
    """All dimensions, those that the fewest vectors use first: one number per dimension, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = None
        for batch in batches:
            if batch.num_rows:
                here = (matrix(batch.column(0)) != 0).sum(axis=0)
                used = here if used is None else used + here
        if used is not None:
            columns = [pa.array(np.arange(len(used)), pa.int32()), pa.array(used, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["dimension", "n"])

    counted = points.select("vec").mapInArrow(count, "dimension int, n bigint")
    counts = counted.groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    return np.array([r.dimension for r in sorted(counts, key=lambda r: (r.n, r.dimension))], np.int64)


_PACKED = "block bigint, dimensions int, ids binary, offsets binary, places binary, weights binary, size bigint"


def _packed(points: DataFrame, order: np.ndarray, block_rows: int) -> DataFrame:
    """One stored row per block of vectors; places are those of the order."""
    parts = max(1, math.ceil(points.count() / block_rows))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        found = matrix(table.column("vec"))[:, order]
        row, place = np.nonzero(found)
        one = {
            "block": table.column("block")[0].as_py(),
            "dimensions": found.shape[1],
            "ids": np.asarray(table.column("id"), "<i8").tobytes(),
            "offsets": np.searchsorted(row, np.arange(len(found) + 1)).astype("<i8").tobytes(),
            "places": place.astype("<i4").tobytes(),
            "weights": found[row, place].astype("<f4").tobytes(),
            "size": 16 * len(found) + 8 * len(row),
        }
        return pa.Table.from_pylist([one], schema)

    binaries = [(c, pa.binary()) for c in ("ids", "offsets", "places", "weights")]
    schema = pa.schema([("block", pa.int64()), ("dimensions", pa.int32()), *binaries, ("size", pa.int64())])
    rows = points.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"), "id", "vec")
    return blocks.stored(rows.groupBy("block").applyInArrow(run, _PACKED), "vector-blocks", block_rows)


@dataclass(frozen=True)
class _Vectors:
    """Some vectors by ascending id, as rows of ``offsets``, and their postings (``row``, ``list``, weight, rest)."""

    ids: np.ndarray
    row: np.ndarray
    places: np.ndarray
    values: np.ndarray
    # Lengths of runs of dimensions.
    lengths: np.ndarray
    posted_row: np.ndarray
    posted_list: np.ndarray
    weight: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, packed: dict, threshold: float) -> _Vectors:
        ids, offsets = (np.frombuffer(packed[c], "<i8") for c in ("ids", "offsets"))
        places = np.frombuffer(packed["places"], "<i4")
        row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        units = np.zeros((len(ids), packed["dimensions"]))
        units[row, places] = np.frombuffer(packed["weights"], "<f4")
        return cls._posted(ids, row, places, unit_rows(units), threshold)

    @classmethod
    def of_block(cls, packed: dict, order: np.ndarray, threshold: float) -> _Vectors:
        """The same of a block of :func:`textcurate.operators.blocks.pack`."""
        found = np.frombuffer(packed["vectors"], "<f4").astype(np.float64).reshape(packed["n"], -1)[:, order]
        row, places = (x.astype(np.int32) for x in np.nonzero(found))
        return cls._posted(np.frombuffer(packed["ids"], "<i8"), row, places, unit_rows(found), threshold)

    @classmethod
    def _posted(cls, ids: np.ndarray, row: np.ndarray, places: np.ndarray, units: np.ndarray, threshold: float) -> _Vectors:
        left = np.sqrt(np.cumsum((units * units)[:, ::-1], axis=1)[:, ::-1])
        posted, lists = np.nonzero((units != 0) & (left >= threshold - _SLACK))
        weight = units[posted, lists]
        rest = np.sqrt(np.maximum(0.0, left[posted, lists] ** 2 - weight**2))
        posted, lists = posted.astype(np.int32), lists.astype(np.int32)
        return cls(ids, row, places, units[row, places], _lengths(units), posted, lists, weight, rest)

    def _dense(self, row: np.ndarray, places: np.ndarray, values: np.ndarray, used: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.ids), len(used)), values.dtype)
        if len(used):
            at = np.minimum(np.searchsorted(used, places), len(used) - 1)
            kept = used[at] == places
            out[row[kept], at[kept]] = values[kept]
        return out

    def dense(self, used: np.ndarray) -> np.ndarray:
        """Whole vectors over the dimensions ``used``, which ascend."""
        return self._dense(self.row, self.places, self.values, used)

    def posted(self, lists: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What postings say, over the lists ``lists``."""
        return self._dense(self.posted_row, self.posted_list, values, lists)


def _lengths(units: np.ndarray) -> np.ndarray:
    """The lengths of runs of dimensions."""
    cuts = np.unique(np.linspace(0, units.shape[1], min(SEGMENTS, units.shape[1]), endpoint=False).astype(int))
    return np.sqrt(np.add.reduceat(units * units, cuts, axis=1))


def _candidates(block: _Vectors, other: _Vectors, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, row, list)``: pairs that share a list and may reach the threshold, each once, with the first list they share."""
    none = np.zeros(0, np.int64)
    lists = np.intersect1d(block.posted_list, other.posted_list)
    if not len(lists):
        return none, none, none
    here = block.posted(lists, np.ones(len(block.posted_list), np.float32))
    there = here if other is block else other.posted(lists, np.ones(len(other.posted_list), np.float32))
    near = here @ there.T > 0
    near &= block.ids[:, None] < other.ids[None, :] if other is block else block.ids[:, None] != other.ids[None, :]
    near &= block.lengths @ other.lengths.T >= threshold - _SLACK
    i, j = np.nonzero(near)
    here, there = here > 0, there > 0
    numbers = [x.posted(lists, values) for x in (block, other) for values in (x.weight, x.rest)]
    found = [(none, none, none)]
    for at in range(0, len(i), _PAIRS_AT_ONCE):
        one, two = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
        # Of two vectors that share a dimension where one is posted, all dimensions shared before it are lists of both.
        first = (here[one] & there[two]).argmax(axis=1)
        bound = numbers[0][one, first] * numbers[2][two, first] + numbers[1][one, first] * numbers[3][two, first]
        kept = bound >= threshold - _SLACK
        found.append((one[kept], two[kept], lists[first[kept]].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _kernel(threshold: float, k: int) -> Callable[[_Vectors, Iterable[_Vectors]], pa.Table]:
    def verify(block: _Vectors, partners: Iterable[_Vectors]) -> pa.Table:
        none = np.zeros(0, np.int64)
        best, least = _pair_table(none, none, np.zeros(0), k), threshold
        for other in partners:
            i, j, _ = _candidates(block, other, least)
            if not len(i):
                continue
            used = np.intersect1d(block.places, other.places)
            left = block.dense(used)
            right = left if other is block else other.dense(used)
            if 32 * len(i) > len(left) * len(right):
                scores = (left @ right.T)[i, j]
            else:
                cuts = [slice(at, at + _PAIRS_AT_ONCE) for at in range(0, len(i), _PAIRS_AT_ONCE)]
                scores = np.concatenate([(left[i[c]] * right[j[c]]).sum(axis=1) for c in cuts])
            kept = np.round(scores, RANK_DECIMALS) >= least
            one, two, scores = block.ids[i[kept]], other.ids[j[kept]], scores[kept]
            every = pa.concat_tables([best, _pair_table(np.minimum(one, two), np.maximum(one, two), scores, k)])
            best = _pair_table(*(np.asarray(every.column(c)) for c in ("a", "b", "similarity")), k)
            if len(best) == k:
                least = max(least, float(np.round(best.column("similarity")[-1].as_py(), RANK_DECIMALS)))
        return best

    return verify


def _candidate_kernel(threshold: float) -> Callable[[_Vectors, Iterable[_Vectors]], pa.Table]:
    def candidates(block: _Vectors, partners: Iterable[_Vectors]) -> pa.Table:
        found = []
        for other in partners:
            i, j, lists = _candidates(block, other, threshold)
            one, two = block.ids[i], other.ids[j]
            columns = [np.minimum(one, two), np.maximum(one, two), lists.astype(np.int32)]
            found.append(pa.table(columns, ["a", "b", "dimension"]))
        return pa.concat_tables(found)

    return candidates


def _every_two(packed: DataFrame) -> DataFrame:
    """``(a, b)``, stored: each two blocks once. Numbers only, a block has ``BLOCK_ROWS`` rows."""
    numbers = materialize(packed.select("block"), "block-numbers")
    pairs = numbers.withColumnRenamed("block", "a").join(numbers.withColumnRenamed("block", "b"), F.col("a") > F.col("b"))
    return materialize(pairs, "meetings")


def _points(rows: DataFrame, threshold: float, copies: int) -> DataFrame:
    if not _SLACK < threshold <= 1:
        raise ValueError(f"vectors that share no dimension never meet, so the threshold must lie above 0 and not above 1: {threshold}")
    return materialize(_distinct_vectors(rows, copies).filter(~_is_zero(F.col("vec"))), "points")


def _index(rows: DataFrame, threshold: float, copies: int, block_rows: int) -> DataFrame:
    points = _points(rows, threshold, copies)
    return _packed(points, _order(points), block_rows)


def _unpacked(threshold: float) -> Callable[[dict], _Vectors]:
    return lambda packed: _Vectors.of(packed, threshold)


def _unpacked_blocks(order: np.ndarray) -> Callable[[float], Callable[[dict], _Vectors]]:
    return lambda threshold: lambda packed: _Vectors.of_block(packed, order, threshold)


def near_duplicates_indexed(
    rows: DataFrame, threshold: float = 0.95, top_k: int = 50, block_rows: int = BLOCK_ROWS, direct_blocks: int = DIRECT_BLOCKS
) -> DataFrame:
    """The ``top_k`` most similar pairs ``(row_a < row_b, similarity)`` with cosine ``>= threshold``, which must be above 0.

    The same rows as :func:`~textcurate.operators.similarity.near_duplicates`; cheaper where vectors are sparse and share
    few rare dimensions. Blocks are first compared within themselves, and the ``top_k``-th pair found raises the threshold.
    """
    if top_k < 1:
        return rows.sparkSession.createDataFrame([], "row_a bigint, row_b bigint, similarity double")
    points = _points(rows, threshold, top_k + 1)
    order, n = _order(points), points.count()
    if n <= direct_blocks * block_rows:
        packed, layout, unpack = _packed(points, order, block_rows), None, _unpacked
    else:
        layout = blocks.make_layout(points, n, block_rows)
        packed, unpack = blocks.pack(blocks.locate(points, layout, block_rows), layout), _unpacked_blocks(order)
    near = blocks.within(packed, _kernel(threshold, top_k), _PAIRS, unpack(threshold))
    near = materialize(_best_pairs(near, top_k), "near")
    count, worst = near.agg(F.count("*"), F.min(ranked(F.col("similarity")))).first()
    if count == top_k and worst > threshold:
        threshold = worst
    kernel = _kernel(threshold, top_k)
    if layout is None:
        found = blocks.across(packed, packed, _every_two(packed), kernel, _PAIRS, unpack(threshold))
    else:
        radius = math.sqrt(max(0.0, 2 - 2 * (threshold - SLACK)))
        found = blocks.meet(packed, packed, layout, blocks.ONCE, kernel, _PAIRS, radius, unpack(threshold))
    at_home = near.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "similarity")
    return _best_pairs(found.unionByName(at_home), top_k)


def candidate_pairs(rows: DataFrame, threshold: float = 0.95, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, dimension)``: the pairs that the index would verify, of one row per vector; to see what it rules out."""
    packed = _index(rows, threshold, 1, block_rows)
    kernel, unpack = _candidate_kernel(threshold), _unpacked(threshold)
    here = blocks.within(packed, kernel, _CANDIDATES, unpack)
    return here.unionByName(blocks.across(packed, packed, _every_two(packed), kernel, _CANDIDATES, unpack))
