"""Cosine search, near-duplicate pairs, nearest neighbours and outliers. Every answer is exact.

Pairs and neighbours share one plan:

1. Copies first. Among rows with the same vector only the lowest few row indices can appear in a bounded answer, so
   the rest are dropped before any comparison. The limit is applied map-side, so copies cost nothing to shuffle; pairs
   and searches do not move vectors of which there are few copies.
2. Blocks. Rows are laid out by a tree over a few coordinates of their vectors and packed, a leaf to a block; the boxes of
   two blocks tell how near their rows can be at most. See :mod:`textcurate.operators.blocks`.
3. A first look. Rows are compared within their own block only. What is found there bounds the answer: pairs below
   the ``top_k``-th found, or rows farther than the neighbours found, cannot matter.
4. Meetings. Only blocks whose boxes are near enough meet, and of these only the rows that are near enough to the other box,
   which are told apart before they are shipped; a task multiplies a block with one partner after the other and returns its own best few only.

Inputs of a few blocks skip steps 2 and 3, which would cost more than they save: every block meets every block once.
Where vectors are about equally far from each other, the boxes rule out little and the work tends to all pairs of blocks;
the memory of a task stays bounded all the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions.vectors import RANK_DECIMALS, cosine_to, matrix, ranked, unit_rows, vector_key
from textcurate.operators import blocks
from textcurate.operators.blocks import FAR, SLACK, Block
from textcurate.plans.scratch import materialize
from textcurate.plans.skew import join_on_unique
from textcurate.schema import ROW_INDEX, VECTOR

BLOCK_ROWS = 2048
# Inputs of up to this many blocks are compared block by block without a layout.
DIRECT_BLOCKS = 16
# Up to this limit Spark applies a rank limit before the exchange (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
SALTS = 1024
# Up to this many names of vectors are broadcast.
CROWDED = 200_000
# Outlier candidates scored exactly before the others are ruled out.
FIRST_BATCH = 1024


def search(rows: DataFrame, query: list[float], k: int = 5, only_kept: bool = False) -> DataFrame:
    """The ``k`` rows most similar to a query vector, with ``score``; one pass and a bounded top-k per task."""
    if only_kept:
        rows = rows.filter("keep")
    scored = rows.withColumn("score", cosine_to(F.col(VECTOR), query))
    return scored.orderBy(ranked(F.col("score")).desc(), ROW_INDEX).limit(max(k, 0))


def search_many(
    rows: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, direct_blocks: int = DIRECT_BLOCKS
) -> DataFrame:
    """For each row ``(query_id, _embedding)`` of a table of queries its ``k`` most similar rows, as :func:`search` gives them:
    ``(query_id, rank, row_index, score)``.

    Equal queries are answered once. Blocks of queries meet the blocks of rows that may hold an answer; each task returns the
    best few per query, which are merged by query, and nothing comes to the driver.
    """
    spark = rows.sparkSession
    if k < 1:
        return spark.createDataFrame([], "query_id bigint, rank int, row_index bigint, score double")
    asked = queries.select("query_id", F.col(VECTOR).alias("vec")).withColumn("vkey", vector_key(F.col("vec")))
    asked = materialize(asked, "queries")
    different = asked.groupBy("vkey").agg(F.first("vec").alias("vec"))
    different = different.select(
        F.monotonically_increasing_id().alias("id"), F.lit(1).alias("copy"), "vec", "vkey", _is_zero(F.col("vec")).alias("zero")
    )
    different = materialize(different, "different-queries")
    state = _NeighborSearch(rows, k, k, block_rows, direct_blocks, numbered=False)
    points = different.filter("NOT zero").select("id", "copy", "vec")
    lists = state.of_queries(points, points.count()).select("id", "rank", "other", "cosine")
    # A query without direction is as near to every row: the lowest k row indices.
    lowest = state._lowest(F.lit(True))
    if lowest:
        entries = F.posexplode(F.array(*[F.lit(i).cast("bigint") for i in lowest])).alias("at", "other")
        none = different.filter("zero").select("id", entries)
        none = none.select("id", (F.col("at") + 1).alias("rank"), "other", F.lit(0.0).alias("cosine"))
        lists = lists.unionByName(none)
    # At most k entries each.
    lists = lists.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "cosine"))).alias("near"))
    by_vector = materialize(different.select("id", "vkey").join(lists, "id").select("vkey", "near"), "answers")
    answered = join_on_unique(asked.select("query_id", "vkey"), by_vector, "vkey").select("query_id", F.explode("near").alias("e"))
    return answered.select(
        "query_id", F.col("e.rank").alias("rank"), F.col("e.other").alias("row_index"), F.col("e.cosine").alias("score")
    )


# ---- step 1: copies


def _distinct_vectors(rows: DataFrame, copies: int) -> DataFrame:
    """Rows ``(id, vec, vkey, copy)``: of each vector the ``copies`` lowest row indices, numbered from 1."""
    keyed = rows.select(F.col(ROW_INDEX).alias("id"), F.col(VECTOR).alias("vec"))
    return _numbered(keyed.withColumn("vkey", vector_key(F.col("vec"))), copies)


def _numbered(keyed: DataFrame, copies: int) -> DataFrame:
    if copies > GROUP_LIMIT:
        # The map-side limit does not work for so many copies, so a common vector is first thinned out by many tasks.
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        thinned = Window.partitionBy("vkey", "salt").orderBy("id")
        keyed = keyed.withColumn("salt", salt).withColumn("copy", F.row_number().over(thinned))
        keyed = keyed.filter(F.col("copy") <= copies).drop("salt", "copy")
    lowest = Window.partitionBy("vkey").orderBy("id")
    return keyed.withColumn("copy", F.row_number().over(lowest)).filter(F.col("copy") <= copies)


def _bounded_copies(rows: DataFrame, copies: int) -> DataFrame:
    """Stored rows ``(id, vec, vkey, zero, copy)``: of each vector that more rows have, the ``copies`` lowest row indices.

    Only vectors with too many rows are exchanged, to be cut; ``copy`` is 1 for the rows of all others.
    """
    keyed = rows.select(F.col(ROW_INDEX).alias("id"), F.col(VECTOR).alias("vec"))
    keyed = keyed.withColumns({"vkey": vector_key(F.col("vec")), "zero": _is_zero(F.col("vec"))})
    keyed = materialize(keyed, "points")
    crowded = keyed.groupBy("vkey").agg(F.count("*").alias("n")).filter(F.col("n") > copies).select("vkey")
    crowded = materialize(crowded, "crowded")
    count = crowded.count()
    if count > CROWDED:
        return materialize(_numbered(keyed, copies), "points")
    numbered = keyed.withColumn("copy", F.lit(1))
    if not count:
        return numbered
    cut = materialize(_numbered(keyed.join(F.broadcast(crowded), "vkey", "left_semi"), copies), "points-cut")
    names = ("id", "vec", "vkey", "zero", "copy")
    return numbered.join(F.broadcast(crowded), "vkey", "left_anti").select(*names).unionByName(cut.select(*names))


def _is_zero(vectors: Column) -> Column:
    return ~F.exists(vectors, lambda x: x != 0)


def _distance(cosine: Column) -> Column:
    """The distance of unit vectors with this cosine, rounded up."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (cosine - SLACK)))


# ---- few blocks: each with each


def _direct(
    left: DataFrame, right: DataFrame, parts: int, kernel: Callable, schema: str, both_ways: bool
) -> DataFrame:
    """Compare all rows of two sides, cut into ``parts`` hash blocks each: at most ``DIRECT_BLOCKS`` squared tasks.

    If both sides hold the same rows, two blocks need to meet one way only.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(parts))
    high = F.lit(parts - 1).cast("bigint")
    low = F.lit(0).cast("bigint")
    others = F.sequence(low if both_ways else own, high)
    here = left.select(own.alias("bl"), F.explode(others).alias("br"), "id", "vec", "side")
    others = F.sequence(low, high if both_ways else own)
    there = right.select(F.explode(others).alias("bl"), own.alias("br"), "id", "vec")
    there = there.withColumn("side", F.when(F.col("bl") == F.col("br"), _HOME).otherwise(_GUEST))
    tasks = parts * parts if both_ways else parts * (parts + 1) // 2
    pairs = here.unionByName(there).repartition(2 * tasks if tasks > 1 else 1, "bl", "br")
    return pairs.groupBy("bl", "br").applyInArrow(kernel, schema)


def _grid(
    left: DataFrame, right: DataFrame, left_parts: int, right_parts: int, kernel: Callable, schema: str
) -> DataFrame:
    """Compare all rows of two sides, each cut into hash parts of its own."""

    def numbers(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))

    def own(parts: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(parts))

    here = left.select(own(left_parts).alias("bl"), numbers(right_parts).alias("br"), "id", "vec", "side")
    there = right.select(numbers(left_parts).alias("bl"), own(right_parts).alias("br"), "id", "vec", "side")
    tasks = left_parts * right_parts
    pairs = here.unionByName(there).repartition(2 * tasks if tasks > 1 else 1, "bl", "br")
    return pairs.groupBy("bl", "br").applyInArrow(kernel, schema)


def _side(points: DataFrame, side: int) -> DataFrame:
    """Rows as one side of a comparison."""
    return points.select("id", "vec", F.lit(side).alias("side"))


_LEFT, _HOME, _GUEST = 0, 1, 2


_PAIRS = "a bigint, b bigint, similarity double"
_NEIGHBORS = "id bigint, other bigint, cosine double"
# Rounding moves a score by half of this at most.
_STEP = 10.0**-RANK_DECIMALS


def _sides(table: pa.Table) -> tuple | None:
    """Row indices and unit rows of the left side, sorted by index, and of the right, and which of the right are
    guests; ``None`` if a side is missing."""
    side = np.asarray(table.column("side").combine_chunks())
    ids = np.asarray(table.column("id").combine_chunks())
    left, right = np.flatnonzero(side == _LEFT), np.flatnonzero(side != _LEFT)
    if not len(left) or not len(right):
        return None
    left = left[np.argsort(ids[left])]
    units = unit_rows(matrix(table.column("vec")))
    return ids[left], units[left], ids[right], units[right], side[right] == _GUEST


def _pair_table(a: np.ndarray, b: np.ndarray, scores: np.ndarray, k: int) -> pa.Table:
    best = np.lexsort((b, a, -np.round(scores, RANK_DECIMALS)))[:k]
    return pa.table({"a": a[best], "b": b[best], "similarity": scores[best]})


def _pairs_of(left, left_units, right, right_units, guest: np.ndarray, threshold: float, k: int) -> pa.Table:
    """The best ``k`` pairs of two sides. Rows that are no guests are on both: their pairs are taken in one order."""
    cosines = left_units @ right_units.T
    i, j = np.nonzero((cosines >= threshold - _STEP) & (guest[None, :] | (left[:, None] < right[None, :])))
    scores = cosines[i, j]
    rank = np.round(scores, RANK_DECIMALS)
    enough = rank >= threshold
    if np.count_nonzero(enough) > k:
        enough = rank >= -np.partition(-rank, k - 1)[k - 1]
    i, j, scores = i[enough], j[enough], scores[enough]
    return _pair_table(np.minimum(left[i], right[j]), np.maximum(left[i], right[j]), scores, k)


def _pair_kernel(threshold: float, k: int) -> Callable[[pa.Table], pa.Table]:
    def best_pairs(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        if sides is None:
            none = np.zeros(0, dtype=np.int64)
            return _pair_table(none, none, np.zeros(0), k)
        return _pairs_of(*sides, threshold, k)

    return best_pairs


def _block_pair_kernel(threshold: float, k: int, radius: float) -> Callable[[Block, Iterable[Block]], pa.Table]:
    """The best ``k`` pairs of a block and its partners, or with itself; no pair is farther apart than ``radius``."""

    def best_pairs(block: Block, partners: Iterable[Block]) -> pa.Table:
        none = np.zeros(0, np.int64)
        best, least = _pair_table(none, none, np.zeros(0), k), threshold
        for other in blocks.joined(partners):
            here, there = block, other
            if other is not block:
                here = block.taken(block.distances_to(other) <= radius + SLACK)
                there = other.taken(other.distances_to(block) <= radius + SLACK)
            guest = np.full(len(there.ids), other is not block)
            found = _pairs_of(here.ids, here.units, there.ids, there.units, guest, least, k)
            if len(found):
                every = pa.concat_tables([best, found])
                best = _pair_table(*(np.asarray(every.column(c)) for c in ("a", "b", "similarity")), k)
            if len(best) == k:
                least = max(least, float(np.round(best.column("similarity")[-1].as_py(), RANK_DECIMALS)))
        return best

    return best_pairs


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.95,
    top_k: int = 50,
    block_rows: int = BLOCK_ROWS,
    direct_blocks: int = DIRECT_BLOCKS,
) -> DataFrame:
    """The ``top_k`` most similar pairs ``(row_a < row_b, similarity)`` with cosine ``>= threshold``."""
    if not -1 <= threshold <= 1:
        raise ValueError(f"a cosine lies within -1 and 1, so {threshold} is no threshold")
    if top_k < 1:
        return rows.sparkSession.createDataFrame([], "row_a bigint, row_b bigint, similarity double")
    # Of equal vectors, any pair with a member past the first top_k + 1 has top_k better or earlier pairs before it.
    points = _bounded_copies(rows, top_k + 1)
    if threshold > SLACK:
        points = points.filter("NOT zero")
    kernel = _pair_kernel(threshold, top_k)
    n = points.count()
    parts = max(1, math.ceil(n / block_rows))
    if parts <= max(1, direct_blocks):
        found = _direct(_side(points, _LEFT), _side(points, _HOME), parts, kernel, _PAIRS, both_ways=False)
        return _best_pairs(found, top_k)
    layout = blocks.make_layout(points, n, block_rows)
    packed = blocks.pack(blocks.locate(points, layout, block_rows), layout)
    near = materialize(_best_pairs(blocks.within(packed, _block_pair_kernel(threshold, top_k, FAR), _PAIRS), top_k), "near")
    count, worst = near.agg(F.count("*"), F.min(ranked(F.col("similarity")))).first()
    # A zero vector has no direction, so distances say nothing about it: if it counts, every block meets every other.
    radius = FAR
    if count == top_k and worst > threshold:
        threshold = worst
    if threshold > SLACK:
        radius = math.sqrt(max(0.0, 2 - 2 * (threshold - SLACK)))
    kernel = _block_pair_kernel(threshold, top_k, radius)
    found = blocks.meet(packed, packed, layout, blocks.ONCE, kernel, _PAIRS, radius)
    pairs_at_home = near.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "similarity")
    return _best_pairs(found.unionByName(pairs_at_home), top_k)


def _best_pairs(found: DataFrame, top_k: int) -> DataFrame:
    found = found.select(F.col("a").alias("row_a"), F.col("b").alias("row_b"), "similarity")
    return found.orderBy(ranked(F.col("similarity")).desc(), "row_a", "row_b").limit(top_k)


# ---- neighbours


# Queries compared with all rows in one go.
_SLICE = 256


def _fewest(at: np.ndarray, others: np.ndarray, scores: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``m`` entries of each query, which ``at`` names by its place; ties go to the lower index."""
    order = np.lexsort((others, -np.round(scores, RANK_DECIMALS), at))
    at = at[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < m
    return at[kept], others[order[kept]], scores[order[kept]]


def _nearest(query_units, rows, row_units, m: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of the query, row, score)`` of the best ``m`` of ``rows``; none with a cosine below the query's ``floor``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, len(query_units) if len(rows) else 0, _SLICE):
        cosines = query_units[first : first + _SLICE] @ row_units.T
        least = floor[first : first + _SLICE]
        crowded = np.flatnonzero(np.count_nonzero(cosines >= least[:, None], axis=1) > m)
        if len(crowded):
            best = np.partition(cosines[crowded], len(rows) - m, axis=1)[:, len(rows) - m]
            least = least.copy()
            # Nothing that much below the m-th score can round to it.
            least[crowded] = np.maximum(least[crowded], best - 2 * _STEP)
        at, row = np.nonzero(cosines >= least[:, None])
        found.append(_fewest(at + first, rows[row], cosines[at, row], m))
    return tuple(np.concatenate(x) for x in zip(*found))


def _neighbor_table(queries, at, others, scores) -> pa.Table:
    return pa.table({"id": queries[at], "other": others, "cosine": scores})


def _neighbors_of(queries, query_units, rows, row_units, m: int) -> pa.Table:
    """The best ``m`` of ``rows`` for each query."""
    if not len(queries) or not len(rows):
        none = np.zeros(0, np.int64)
        return _neighbor_table(none, none, none, np.zeros(0))
    return _neighbor_table(queries, *_nearest(query_units, rows, row_units, m, np.full(len(queries), -np.inf)))


def _neighbor_kernel(m: int) -> Callable[[pa.Table], pa.Table]:
    def best_neighbors(table: pa.Table) -> pa.Table:
        sides = _sides(table)
        if sides is None:
            none = np.zeros(0, dtype=np.int64)
            return _neighbors_of(none, None, none, None, m)
        left, left_units, right, right_units, _ = sides
        return _neighbors_of(right, right_units, left, left_units, m)

    return best_neighbors


def _home_neighbor_kernel(m: int) -> Callable[[Block, Iterable[Block]], pa.Table]:
    """The best ``m`` within a block, for the rows of it that look around (those with a radius)."""

    def best_neighbors(block: Block, partners: Iterable[Block]) -> pa.Table:
        asking = block.taken(block.radii > 0)
        found = [_neighbors_of(asking.ids, asking.units, other.ids, other.units, m) for other in partners]
        return pa.concat_tables(found)

    return best_neighbors


def _block_neighbor_kernel(m: int, enough: float | None = None) -> Callable[[Block, Iterable[Block]], pa.Table]:
    """Of all partners the best ``m`` within the radius of each row; only rows near enough to a partner's box meet it.

    A row looks no further once the mean of its best ``m - 1`` lies above ``enough``, if that is all that is asked of it.
    """

    def best_neighbors(block: Block, partners: Iterable[Block]) -> pa.Table:
        # The radius was rounded up, so that no row with the least cosine that counts lies below this.
        floor = 1 - block.radii**2 / 2 - SLACK
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        live, looking = np.arange(len(floor)), block
        for other in blocks.joined(partners):
            asking = live[looking.distances_to(other) <= looking.radii + SLACK]
            if not len(asking):
                continue
            reach = block.radii[asking].max(initial=0.0)
            rows = other.taken(other.distances_to(block) <= reach + SLACK)
            at, others, scores = _nearest(block.units[asking], rows.ids, rows.units, m, floor[asking])
            if not len(at):
                continue
            best = _fewest(*(np.concatenate(x) for x in zip(best, (asking[at], others, scores))), m)
            # What lies below the m-th score found so far cannot matter any more.
            counts = np.bincount(best[0], minlength=len(floor))
            last = np.flatnonzero(counts == m)
            worst = best[2][np.searchsorted(best[0], last, side="right") - 1]
            floor[last] = np.maximum(floor[last], worst - 2 * _STEP)
            if enough is not None:
                place = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
                sums = np.bincount(best[0], weights=np.where(place < m - 1, best[2], 0.0), minlength=len(floor))
                live = live[~((counts >= m - 1) & (sums > (m - 1) * enough))[live]]
                if not len(live):
                    break
                looking = block.taken(live) if len(live) < len(floor) else block
        return _neighbor_table(block.ids, *best)

    return best_neighbors


class _NeighborSearch:
    """The ``m`` best rows for each distinct vector, itself included, in two steps: at home, then where needed."""

    def __init__(
        self, rows: DataFrame, m: int, copies: int, block_rows: int, direct_blocks: int, numbered: bool = True
    ):
        """``numbered`` tells apart the copies of a vector, which only the search for rows' own neighbours needs."""
        self.m, self.block_rows = m, block_rows
        if numbered:
            points = _distinct_vectors(rows, max(m, copies)).withColumn("zero", _is_zero(F.col("vec")))
            self.points = materialize(points, "points")
        else:
            self.points = _bounded_copies(rows, max(m, copies))
        n, zeros = self.points.agg(F.count("*"), F.count_if("zero")).first()
        # A zero vector is at cosine 0 from every row, so its best are the lowest indices, and of all zero vectors
        # only the lowest m can be anyone's neighbours. Both lists hold m row indices at most.
        self.zero_ids = self._lowest(F.col("zero")) if zeros else []
        self.lowest_ids = self._lowest(F.lit(True)) if zeros else []
        self.parts = max(1, math.ceil(n / block_rows))
        self.direct = self.parts <= max(1, direct_blocks)
        directed = self.points.filter((F.col("copy") <= m) & ~F.col("zero"))
        if self.direct:
            self.targets = directed
        else:
            self.layout = blocks.make_layout(directed, n, block_rows)
            self.targets = blocks.locate(directed, self.layout, block_rows)
            looks = F.when(F.col("copy") == 1, FAR).otherwise(0.0)
            self.packed = blocks.pack(self.targets.withColumn("radius", looks), self.layout)
        self.queries = self.targets.filter("copy = 1")

    def _lowest(self, where: Column) -> list[int]:
        ids = self.points.filter(where & (F.col("copy") <= self.m)).select("id").orderBy("id").limit(self.m)
        return [r[0] for r in ids.collect()]

    def _best(self, found: DataFrame, queries: DataFrame | None = None) -> DataFrame:
        """The best ``m`` of what was found, for ``queries`` also of the zero vectors, which no block holds."""
        if self.zero_ids and queries is not None:
            ids = F.array(*[F.lit(i).cast("bigint") for i in self.zero_ids])
            found = found.unionByName(queries.select("id", F.explode(ids).alias("other"), F.lit(0.0).alias("cosine")))
        best = Window.partitionBy("id").orderBy(ranked(F.col("cosine")).desc(), "other")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.m)

    def of_zero(self) -> DataFrame:
        """The list of the one distinct zero vector, if there is one; already exact."""
        spark = self.points.sparkSession
        rows = [(self.zero_ids[0], other, 0.0, i + 1) for i, other in enumerate(self.lowest_ids)]
        return spark.createDataFrame(rows, f"{_NEIGHBORS}, rank int")

    def at_home(self) -> DataFrame:
        """For each distinct nonzero vector the best of its own block, or of all rows if there are few:
        ``(id, other, cosine, rank)``."""
        if self.direct:
            left, right = _side(self.targets, _LEFT), _side(self.queries, _HOME)
            kernel = _neighbor_kernel(self.m)
            return self._best(_direct(left, right, self.parts, kernel, _NEIGHBORS, both_ways=True), self.queries)
        found = blocks.within(self.packed, _home_neighbor_kernel(self.m), _NEIGHBORS)
        return materialize(self._best(found, self.queries), "neighbors-home")

    def complete(self, home: DataFrame, enough: float | None = None, beside: bool = False) -> DataFrame:
        """The exact lists of the vectors that ``home`` has lists for.

        With ``enough``, a list may be cut short once the mean cosine of its others lies above it; with ``beside`` only rows of
        neighbouring blocks are looked at.
        """
        if self.direct:
            return home
        moving = self.queries.join(self._radii(home), "id")
        askers = blocks.pack(moving, self.layout)
        kernel = _block_neighbor_kernel(self.m, enough)
        found = blocks.meet(askers, self.packed, self.layout, blocks.OTHERS, kernel, _NEIGHBORS, beside=beside)
        return self._best(found.unionByName(home.select("id", "other", "cosine")))

    def of_queries(self, points: DataFrame, count: int) -> DataFrame:
        """The exact lists of other vectors, nonzero rows ``(id, copy, vec)``, that are no rows of the table."""
        if self.direct:
            kernel = _neighbor_kernel(self.m)
            asking = max(1, math.ceil(count / self.block_rows))
            found = _grid(_side(self.targets, _LEFT), _side(points, _GUEST), self.parts, asking, kernel, _NEIGHBORS)
            return self._best(found, points)
        kernel = _block_neighbor_kernel(self.m)
        located = blocks.locate(points, self.layout, self.block_rows)
        # A first look at one block of the leaf that a query falls in bounds its answer.
        asking = located.select("leaf", F.col("block").alias("a")).distinct()
        first = asking.join(self.packed.groupBy("leaf").agg(F.min("block").alias("b")), "leaf").select("a", "b")
        askers = blocks.pack(located.withColumn("radius", F.lit(FAR)), self.layout)
        near = blocks.across(askers, self.packed, materialize(first, "first-looks"), kernel, _NEIGHBORS)
        moving = located.join(self._radii(self._best(near)), "id", "left").fillna(FAR, ["radius"])
        askers = blocks.pack(moving, self.layout)
        return self._best(blocks.meet(askers, self.packed, self.layout, blocks.ALL, kernel, _NEIGHBORS), located)

    def _radii(self, lists: DataFrame) -> DataFrame:
        """How far each id of the lists still has to look: with fewer than ``m`` rows found so far, everywhere."""
        worst = lists.groupBy("id").agg(F.max(F.when(F.col("rank") == self.m, F.col("cosine"))).alias("worst"))
        radius = F.when(F.col("worst").isNotNull(), _distance(F.col("worst"))).otherwise(F.lit(FAR))
        return worst.select("id", radius.alias("radius"))


def _check_neighbors(n: int) -> None:
    if n < 1:
        raise ValueError(f"at least one neighbour is needed, not {n}")


def knn(
    rows: DataFrame, n_neighbors: int = 5, block_rows: int = BLOCK_ROWS, direct_blocks: int = DIRECT_BLOCKS
) -> DataFrame:
    """For every row its ``n_neighbors`` most similar other rows: ``(row_index, rank, neighbor, similarity)``."""
    _check_neighbors(n_neighbors)
    # One more than asked for, because a row is found among its own neighbours.
    m = n_neighbors + 1
    state = _NeighborSearch(rows, m, 1, block_rows, direct_blocks)
    lists = state.complete(state.at_home()).unionByName(state.of_zero()).groupBy("id").agg(
        # At most m entries each.
        F.sort_array(F.collect_list(F.struct("rank", "other", "cosine"))).alias("near")
    )
    by_vector = state.points.filter("copy = 1").select("id", "vkey").join(lists, "id").select("vkey", "near")
    if not state.direct:
        by_vector = materialize(by_vector, "neighbors")
    every = rows.select(F.col(ROW_INDEX).alias("row_index"), vector_key(F.col(VECTOR)).alias("vkey"))
    joined = join_on_unique(every, by_vector, "vkey")
    others = F.slice(F.filter("near", lambda e: e["other"] != F.col("row_index")), 1, n_neighbors)
    return joined.select("row_index", F.posexplode(others).alias("pos", "e")).select(
        "row_index",
        (F.col("pos") + 1).alias("rank"),
        F.col("e.other").alias("neighbor"),
        F.col("e.cosine").alias("similarity"),
    )


def _isolation(lists: DataFrame, n: int) -> DataFrame:
    """``(id, score)`` per distinct vector; a list too short to tell scores higher than any real score.

    A vector's own entry is one of the list's highest cosines, 1 (or 0 for a zero vector), and is left out once.
    Copies of a row share its list, so they share its score.
    """
    own = F.max(F.when(F.col("other") == F.col("id"), F.col("cosine")))
    mean = (F.sum("cosine") - F.coalesce(own, F.lit(0.0))) / n
    # If the row itself has dropped off its list, all entries are copies and the last one stands in for it.
    crowded = (F.sum("cosine") - F.min("cosine")) / n
    mean = F.when(own.isNull(), crowded).otherwise(mean)
    return lists.groupBy("id").agg(
        F.when(F.count("*") == n + 1, 1 - mean).otherwise(F.lit(FAR)).alias("score")
    )


def find_outliers(
    rows: DataFrame,
    top_k: int = 10,
    n_neighbors: int = 5,
    block_rows: int = BLOCK_ROWS,
    direct_blocks: int = DIRECT_BLOCKS,
) -> DataFrame:
    """The ``top_k`` rows with the highest ``1 - mean cosine`` to their nearest rows: ``(row_index, outlier_score)``.

    A row's neighbours within its own cell already bound its score from above. A first batch with the highest bounds
    is scored exactly; its ``top_k``-th score then rules out every row whose bound is lower. Many others find near enough rows
    in the blocks beside their own; the few that are left meet all that may matter to them.
    """
    _check_neighbors(n_neighbors)
    spark = rows.sparkSession
    size = rows.count()
    if size < 2 or top_k < 1:
        return spark.createDataFrame([], "row_index bigint, outlier_score double")
    n = max(1, min(n_neighbors, size - 1))
    state = _NeighborSearch(rows, n + 1, top_k, block_rows, direct_blocks)
    home = state.at_home()
    zero = _isolation(state.of_zero(), n)
    if state.direct:
        scores = _isolation(home, n).unionByName(zero)
    else:
        bounds = materialize(_isolation(home, n), "bounds")
        batch = max(4 * top_k, FIRST_BATCH)
        first = materialize(bounds.orderBy(F.col("score").desc(), "id").limit(batch), "first-batch")
        exact = state.complete(home.join(first.select("id"), "id", "left_semi"))
        exact = materialize(_isolation(exact, n).unionByName(zero), "exact-first")
        best = exact.orderBy(F.col("score").desc()).limit(top_k).agg(F.count("*"), F.min("score")).first()
        cutoff = best[1] if best[0] == top_k else -FAR
        # A score is 1 less the mean: whoever has found a higher mean scores below the cutoff.
        enough = 1 - cutoff + SLACK
        rest = materialize(bounds.filter(F.col("score") >= cutoff - SLACK).join(first, "id", "left_anti"), "rest")
        if rest.count() > batch:
            # Next to all of them find enough among their neighbours, and need not meet the whole table.
            nearby = state.complete(home.join(rest.select("id"), "id", "left_semi"), enough, beside=True)
            rest = materialize(_isolation(nearby, n).filter(F.col("score") >= cutoff - SLACK), "rest")
        rest = state.complete(home.join(rest.select("id"), "id", "left_semi"), enough)
        scores = exact.unionByName(_isolation(rest, n))
    leading = scores.orderBy(ranked(F.col("score")).desc(), "id").limit(top_k)
    # All stored copies of the leading vectors, up to top_k of each, compete for the top_k places.
    names = state.points.filter("copy = 1").select("id", "vkey").join(leading, "id")
    names = names.select("vkey", "score")
    members = state.points.filter(F.col("copy") <= top_k).select("id", "vkey").join(names, "vkey")
    return members.select(F.col("id").alias("row_index"), F.col("score").alias("outlier_score")).orderBy(
        ranked(F.col("outlier_score")).desc(), "row_index"
    ).limit(top_k)
