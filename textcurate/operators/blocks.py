"""Packed blocks of unit vectors, and which of them need to meet.

A unit vector is known by a few coordinates: those along the principal axes of a sample, and the length of what is left.
For two unit vectors x.y <= Px.Py + |rest x||rest y|, which is the same as saying that these coordinates lie no farther
apart than the vectors do. Rows are laid out by a tree of splits along the coordinates, and the rows of a leaf become
one packed row, a block, with the box that its coordinates fill. Two blocks whose boxes are farther apart than
the wanted distance never meet. Pairs of boxes are found from the root of the tree down, level by level, by joins on the
node above, so that a pair of distant nodes rules out all that lies below both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textcurate.functions.vectors import matrix, unit_rows
from textcurate.plans.scratch import materialize

# Coordinates beside the length of the rest; more of them cost time and rule out little more.
AXES = 8
# Rows whose vectors go to the driver to find axes (16 MB at 1024 floats), and rows of which only the coordinates do.
AXES_SAMPLE, SPLIT_SAMPLE = 4096, 1 << 18
# The tree has so many leaves at most; a leaf that holds more than a block is cut further by row hash. Beyond
# MAX_LEAVES blocks, boxes stop shrinking as the data grows: that costs speed, and no results.
MAX_LEAVES = 1 << 14
# Children of a node per step from the root down, as a power of two.
STEP_BITS = 4
# Packed bytes of one side that a task holds at once, and rows of partners that are compared in one go.
GROUP_BYTES = 32 << 20
CHUNK_ROWS, CHUNK_BLOCKS = 4096, 64
# Distances get this much slack, more than the rounding of scores and arithmetic can amount to.
SLACK = 1e-6
FAR = 4.0

_PACKED = (
    "block bigint, leaf bigint, n int, ids binary, vectors binary, coordinates binary, radii binary, "
    "low array<double>, high array<double>, reach double, size bigint"
)


@dataclass(frozen=True)
class Layout:
    """Axes as columns, and for each inner node of a binary tree, in heap order, the coordinate and value it splits at."""

    axes: np.ndarray
    coordinate: np.ndarray
    value: np.ndarray

    @property
    def bits(self) -> int:
        return (len(self.value) + 1).bit_length() - 1

    def coordinates(self, units: np.ndarray) -> np.ndarray:
        """Coordinates of unit rows, or of zero rows, whose rest is nothing too."""
        along = units @ self.axes
        rest = (units * units).sum(axis=1) - (along * along).sum(axis=1)
        return np.hstack([along, np.sqrt(np.maximum(0.0, rest))[:, None]])

    def leaves(self, coordinates: np.ndarray) -> np.ndarray:
        node = np.zeros(len(coordinates), np.int64)
        rows = np.arange(len(coordinates))
        for _ in range(self.bits):
            right = coordinates[rows, self.coordinate[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - len(self.value)


def _units(vectors: pa.Array, step: int = 4096) -> Iterator[np.ndarray]:
    for at in range(0, len(vectors), step):
        yield unit_rows(matrix(vectors.slice(at, step)))


def _some(points: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` rows, chosen by a hash of their vectors: the same ones in every run."""
    if rows <= wanted:
        return points
    return points.filter(F.xxhash64("vkey") < int(-(2**63) + 2**64 * (wanted / rows)))


def make_layout(points: DataFrame, rows: int, block_rows: int) -> Layout:
    """Axes and splits for rows ``(vkey, vec)``, of which a sample of bounded size comes to the driver."""
    # The sample's size varies around its mean, so that twice as many stay a safe bound.
    sample = _some(points, rows, AXES_SAMPLE // 2).orderBy("vkey").limit(AXES_SAMPLE).select("vec").collect()
    units = unit_rows(np.asarray([r[0] for r in sample], np.float64)) if sample else np.zeros((0, 1))
    _, axes = np.linalg.eigh(units.T @ units)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :AXES])
    bits = min(MAX_LEAVES, max(1, math.ceil(rows / block_rows))) - 1
    bits = bits.bit_length()
    seed = Layout(axes, np.zeros(0, np.int64), np.zeros(0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for units in _units(batch.column(0)):
                found = seed.coordinates(units)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64()))], ["at"])

    wanted = min(SPLIT_SAMPLE, 32 << bits)
    few = _some(points, rows, wanted // 2).select("vec").mapInArrow(place, "at array<double>").limit(wanted)
    at = matrix(few.toArrow().column(0))
    if not len(at):
        at = np.zeros((1, axes.shape[1] + 1))
    coordinate, value = np.zeros((1 << bits) - 1, np.int64), np.zeros((1 << bits) - 1)
    groups = {0: np.arange(len(at))}
    for node in range(len(value)):
        rows_here = groups.pop(node)
        here = at[rows_here]
        if len(here):
            coordinate[node] = here.var(axis=0).argmax()
            value[node] = np.median(here[:, coordinate[node]])
        right = here[:, coordinate[node]] > value[node]
        groups[2 * node + 1], groups[2 * node + 2] = rows_here[~right], rows_here[right]
    return Layout(axes, coordinate, value)


def locate(points: DataFrame, layout: Layout, block_rows: int) -> DataFrame:
    """Rows ``(id, copy, vec, leaf, block)``: a block is a leaf, or one hash part of a leaf that holds more.

    Blocks are numbered from leaf to leaf, without gaps but for empty parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout.leaves(layout.coordinates(units)) for units in _units(batch.column("vec"))]
            leaf = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], [*batch.schema.names, "leaf"])

    rows = points.select("id", F.col("copy").cast("int").alias("copy"), "vec")
    rows = materialize(rows.mapInArrow(run, "id bigint, copy int, vec array<float>, leaf bigint"), "leaves")
    # One row per leaf, so MAX_LEAVES at most, here and in the window.
    parts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("first", F.coalesce(F.sum("parts").over(before), F.lit(0))), "leaf-parts")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    return rows.join(F.broadcast(parts), "leaf").select("id", "copy", "vec", "leaf", block.alias("block"))


def stored(packed: DataFrame, label: str, block_rows: int) -> DataFrame:
    """Packed blocks, stored in row groups of some tens of MB, since a row is up to a few MB."""
    return materialize(packed, label, group_rows=max(16, (16 * 1024) // block_rows))


def pack(rows: DataFrame, layout: Layout) -> DataFrame:
    """One stored row per block of ``(id, vec, leaf, block)`` and, if there is one, ``radius``, the distance a row looks within."""
    radius = F.col("radius") if "radius" in rows.columns else F.lit(0.0)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        found = matrix(table.column("vec"))
        at = layout.coordinates(unit_rows(found))
        radii = np.asarray(table.column("radius"), np.float64)
        ids, vectors = np.asarray(table.column("id"), "<i8").tobytes(), found.astype("<f4").tobytes()
        at_bytes, radii_bytes = at.astype("<f8").tobytes(), radii.astype("<f8").tobytes()
        fields = [
            [table.column("block")[0].as_py()],
            [table.column("leaf")[0].as_py()],
            [len(found)],
            [ids],
            [vectors],
            [at_bytes],
            [radii_bytes],
            [at.min(axis=0).tolist()],
            [at.max(axis=0).tolist()],
            [float(radii.max())],
            [len(ids) + len(vectors) + len(at_bytes) + len(radii_bytes)],
        ]
        return pa.table(fields, schema)

    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("leaf", pa.int64()),
            ("n", pa.int32()),
            *[(name, pa.binary()) for name in ("ids", "vectors", "coordinates", "radii")],
            *[(name, pa.list_(pa.float64())) for name in ("low", "high")],
            ("reach", pa.float64()),
            ("size", pa.int64()),
        ]
    )
    rows = rows.select("block", "leaf", "id", "vec", radius.cast("double").alias("radius"))
    return stored(rows.groupBy("block", "leaf").applyInArrow(run, _PACKED), "packed", 1024)


@dataclass(frozen=True)
class Block:
    """A packed block in a task, rows by ascending id, or several of them; ``low`` and ``high`` have a row per box."""

    ids: np.ndarray
    units: np.ndarray
    coordinates: np.ndarray
    radii: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        n = row["n"]
        vectors = np.frombuffer(row["vectors"], "<f4").astype(np.float64).reshape(n, -1)
        return cls(
            np.frombuffer(row["ids"], "<i8"),
            unit_rows(vectors),
            np.frombuffer(row["coordinates"], "<f8").reshape(n, -1),
            np.frombuffer(row["radii"], "<f8"),
            np.asarray([row["low"]]),
            np.asarray([row["high"]]),
        )

    def distances_to(self, other: Block) -> np.ndarray:
        """How far each row is from the nearest of the other block's boxes, at least."""
        at = self.coordinates[:, None]
        gap = np.maximum(0.0, np.maximum(other.low - at, at - other.high))
        return np.sqrt((gap * gap).sum(axis=2).min(axis=1))

    def taken(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.units[rows], self.coordinates[rows], self.radii[rows], self.low, self.high)


def joined(partners: Iterable[Block]) -> Iterator[Block]:
    """Partners put together to about ``CHUNK_ROWS`` rows, so that small blocks cost no more than large ones do."""
    held, rows = [], 0
    for block in partners:
        if held and (rows + len(block.ids) > CHUNK_ROWS or len(held) == CHUNK_BLOCKS):
            yield _together(held)
            held, rows = [], 0
        held.append(block)
        rows += len(block.ids)
    if held:
        yield _together(held)


def _together(some: list[Block]) -> Block:
    if len(some) == 1:
        return some[0]
    names = ("ids", "units", "coordinates", "radii", "low", "high")
    return Block(*(np.concatenate([getattr(b, name) for b in some]) for name in names))


def _box_distance(a: str, b: str) -> Column:
    below = F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y)
    above = F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y)
    gaps = F.zip_with(below, above, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))


def _nodes(boxes: DataFrame, axes: int, mask: int) -> DataFrame:
    """The boxes of all tree nodes of one level, by leaf number with the bits below that level cleared."""
    low = F.array(*[F.min(F.col("low")[k]) for k in range(axes)])
    high = F.array(*[F.max(F.col("high")[k]) for k in range(axes)])
    node = F.col("leaf").bitwiseAND(F.lit(mask)).alias("node")
    return boxes.groupBy(node).agg(low.alias("low"), high.alias("high"), F.max("reach").alias("reach"))


# Which pairs of near blocks meet: each two of one table once (the larger number asks), or all but a block with itself, or
# all of two tables with numbers of their own.
ONCE, OTHERS, ALL = "once", "others", "all"


def meetings(askers: DataFrame, others: DataFrame, layout: Layout, which: str) -> DataFrame:
    """``(a, b)``, stored: blocks ``b`` that lie within the reach of ``a``.

    ``askers`` and ``others`` are packed blocks, or their boxes. The work is that of the pairs of nodes that are near
    each other: level by level their children meet, joined on the nodes above them, down to the blocks of a leaf.
    """
    axes = layout.axes.shape[1] + 1
    sides = [materialize(side.select("block", "leaf", "low", "high", "reach"), "boxes") for side in (askers, others)]
    everything = (1 << layout.bits) - 1
    pairs, upper = None, 0
    for depth in [*range(0, layout.bits, STEP_BITS), layout.bits, None]:
        mask = everything if depth is None else everything ^ ((1 << (layout.bits - depth)) - 1)
        level = []
        for side, name in zip(sides, "ab"):
            nodes = _nodes(side, axes, mask) if depth is not None else side.withColumnRenamed("block", "node")
            above = F.col("node") if depth is not None else F.col("leaf")
            box = F.struct("low", "high", "reach").alias(f"{name}_box")
            level.append(nodes.select(above.bitwiseAND(F.lit(upper)).alias(f"up_{name}"), F.col("node").alias(name), box))
        if pairs is None:  # the root against the root
            pairs = level[0].join(level[1], F.col("up_a") == F.col("up_b"))
        else:
            pairs = pairs.join(level[0], "up_a").join(level[1], "up_b")
        pairs = pairs.filter(_box_distance("a_box", "b_box") <= F.col("a_box.reach") + SLACK)
        if depth is None:
            pairs = pairs.filter({ONCE: "a > b", OTHERS: "a <> b", ALL: "true"}[which]).select("a", "b")
        else:
            pairs = pairs.filter("a >= b") if which == ONCE else pairs
            pairs = pairs.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
        upper = mask
    return materialize(pairs, "meetings")


def within(
    packed: DataFrame, kernel: Callable[[Block, Iterable[Block]], pa.Table], schema: str, unpack: Callable = Block.of
) -> DataFrame:
    """Every block against itself, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = unpack(batch.slice(k, 1).to_pylist()[0])
                yield from kernel(block, [block]).to_batches()

    return packed.mapInArrow(run, schema)


def _grouped(sizes: DataFrame, total: int, parts: int) -> DataFrame:
    """``(block, group)``, stored: blocks ``(block, size)`` in ``parts`` runs of neighbouring numbers and about equal size."""
    group = _group_of(_bounds(sizes, total, parts))
    return materialize(sizes.select("block", group("block").alias("group")), "groups")


def _bounds(sizes: DataFrame, total: int, parts: int) -> np.ndarray:
    """The last block of each run but the last one."""
    if parts <= 1:
        return np.zeros(0, np.int64)
    # A large block counts several times.
    times = F.ceil(F.col("size") * (16 * parts) / total).cast("int")
    weighted = sizes.select("block", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), times))))
    shares = [k / parts for k in range(1, parts)]
    found = weighted.agg(F.percentile_approx("block", shares, max(10_000, 20 * parts))).first()[0]
    return np.unique(np.array(found or [], np.int64))


def _group_of(bounds: np.ndarray) -> Callable:
    @F.arrow_udf(T.IntegerType())
    def group(numbers: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, np.asarray(numbers)).astype(np.int32))

    return group


def _measured(askers: DataFrame, others: DataFrame) -> tuple[list[DataFrame], list[tuple], tuple[int, int]]:
    """``(block, size)`` of each side, how many and how much they are, and into how many groups each is dealt."""
    wanted = 4 * askers.sparkSession.sparkContext.defaultParallelism
    sides = [side.select("block", "size") for side in ((askers,) if askers is others else (askers, others))]
    measured = [side.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first() for side in sides]
    (n_a, bytes_a), (n_b, bytes_b) = measured[0], measured[-1]
    # Shipped are the bytes of one side times the groups of the other: least where both sides' groups are of one size.
    parts_a = max(-(-bytes_a // GROUP_BYTES), round(math.sqrt(wanted * bytes_a / max(1, bytes_b))), 1)
    parts_a = min(parts_a, max(1, n_a))
    parts_b = min(max(-(-bytes_b // GROUP_BYTES), -(-wanted // parts_a)), max(1, n_b))
    if askers is others:
        parts_a = parts_b = max(parts_a, parts_b)
    return sides, measured, (parts_a, parts_b)


def _partitions(spark: SparkSession, tasks: int) -> int:
    """The work of a task is in its arithmetic: partitions grow in number with the tasks, and not in size."""
    at_once = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return int(max(1, min(2 * tasks, max(at_once, tasks // 8))))


def _near_rows(
    met: DataFrame, askers: DataFrame, others: DataFrame, left: DataFrame, right: DataFrame, columns: list[str], radius: float
) -> tuple[DataFrame, DataFrame]:
    """Both sides with their blocks, of which only the rows are left that are near enough to the box of a partner."""
    pairs = met.select("ga", "gb", "a", F.explode("partners").alias("b"))
    here = askers.select(F.col("block").alias("a"), "low", "high", F.greatest("reach", F.lit(radius)).alias("reach"))
    # The rows of an asking block look within distances of their own, the others as far as the asking block does.
    there = others.select(F.col("block").alias("b"), "low", "high", F.lit(radius).alias("reach"))
    box = F.collect_list(F.struct("low", "high", "reach")).alias("boxes")
    of_left = pairs.join(there, "b").groupBy("ga", "gb", F.col("a").alias("block")).agg(box)
    of_right = pairs.join(here, "a").groupBy("ga", "gb", F.col("b").alias("block")).agg(box)
    names = ["ga", "gb", "block", "partners", *columns]

    def thinned(rows: DataFrame, boxes: DataFrame, blocks: DataFrame, asking: bool) -> DataFrame:
        # Stored, so that its size is known to the join with the blocks, which then need not be moved where it is small.
        rows = materialize(rows.join(boxes, ["ga", "gb", "block"]), "boxes-near")
        rows = rows.join(blocks.select("block", *columns), "block").select(*names, "boxes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    row = one.to_pylist()[0]
                    kept = _kept_rows(row, asking)
                    if not kept.any():
                        continue
                    if not kept.all():
                        cut = {c: _cut(row[c], row["n"], kept) for c in ("ids", "vectors", "coordinates", "radii")}
                        row = row | cut | {"n": int(kept.sum())}
                        del row["boxes"]
                        yield pa.RecordBatch.from_pylist([row], one.select(names).schema)
                    else:
                        yield one.select(names)

        return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in names]))

    return thinned(left, of_left, askers, True), thinned(right, of_right, others, False)


def _kept_rows(row: dict, asking: bool) -> np.ndarray:
    """Which rows of a packed block lie near enough to any of the boxes."""
    at = np.frombuffer(row["coordinates"], "<f8").reshape(row["n"], -1)
    own = np.frombuffer(row["radii"], "<f8") if asking else np.zeros(row["n"])
    kept = np.zeros(row["n"], bool)
    for box in row["boxes"]:
        rest = np.flatnonzero(~kept)
        if not len(rest):
            break
        gap = np.maximum(0.0, np.maximum(np.asarray(box["low"]) - at[rest], at[rest] - np.asarray(box["high"])))
        kept[rest] = np.sqrt((gap * gap).sum(axis=1)) <= np.maximum(own[rest], box["reach"]) + SLACK
    return kept


def _cut(packed: bytes, n: int, kept: np.ndarray) -> bytes:
    return np.frombuffer(packed, np.uint8).reshape(n, -1)[kept].tobytes()


def across(
    askers: DataFrame,
    others: DataFrame,
    pairs: DataFrame,
    kernel: Callable[[Block, Iterable[Block]], pa.Table],
    schema: str,
    unpack: Callable = Block.of,
    radius: float | None = None,
) -> DataFrame:
    """Every block ``a`` against those ``b`` that ``pairs`` gives it.

    The blocks of either side are dealt into groups of neighbours of ``GROUP_BYTES`` at most, or smaller ones where
    there would be too few tasks. A task holds a group of each side and compares all their pairs, so that a block is shipped once
    for a group that it has a partner in, and not once for a partner. With a ``radius``, of blocks made by :func:`pack` only
    the rows are shipped that lie within it of a partner's box, or within the distance that the asking rows look if that is more.
    """
    sides, measured, dealt = _measured(askers, others)
    groups = [_grouped(side, total, parts) for side, (_, total), parts in zip(sides, measured, dealt)]
    of_a, of_b = (groups[k].select(F.col("block").alias(x), F.col("group").alias(f"g{x}")) for k, x in ((0, "a"), (-1, "b")))
    met = pairs.join(of_a, "a").join(of_b, "b")
    met = met.groupBy("ga", "gb", "a").agg(F.sort_array(F.collect_list("b")).alias("partners"))
    met = materialize(met, "partners")
    tasks = met.select("ga", "gb").distinct().count()
    columns = [c for c in askers.columns if c not in ("block", "leaf", "reach", "size")]
    left = met.select("ga", "gb", F.col("a").alias("block"), "partners")
    right = met.select("ga", "gb", F.explode("partners").alias("block")).distinct()
    right = right.withColumn("partners", F.lit(None).cast("array<bigint>"))
    if radius is None:
        left, right = left.join(askers.select("block", *columns), "block"), right.join(others.select("block", *columns), "block")
    else:
        left, right = _near_rows(met, askers, others, left, right, columns, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asking = np.asarray(table.column("partners").is_valid())
        numbers = np.asarray(table.column("block"))
        there = {int(numbers[k]): unpack(table.slice(k, 1).to_pylist()[0]) for k in np.flatnonzero(~asking).tolist()}
        for k in sorted(np.flatnonzero(asking).tolist(), key=numbers.__getitem__):
            row = table.slice(k, 1).to_pylist()[0]
            partners = [there[b] for b in row["partners"] if b in there]
            if partners:
                yield from kernel(unpack(row), partners).combine_chunks().to_batches()

    rows = left.select(*right.columns).unionByName(right).repartition(_partitions(pairs.sparkSession, tasks), "ga", "gb")
    return rows.groupBy("ga", "gb").applyInArrow(run, schema)


@dataclass(frozen=True)
class _Boxes:
    """What is known everywhere of the blocks of one side: the groups they are dealt into, and a box for each leaf in each.

    There are ``MAX_LEAVES`` boxes and one more for a group at most, a few MB, however many blocks there are.
    """

    bounds: np.ndarray
    group: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray

    @classmethod
    def of(cls, side: DataFrame, sizes: DataFrame, total: int, parts: int, layout: Layout, radius: float) -> _Boxes:
        bounds, axes = _bounds(sizes, total, parts), layout.axes.shape[1] + 1
        low = F.array(*[F.min(F.col("low")[k]) for k in range(axes)])
        high = F.array(*[F.max(F.col("high")[k]) for k in range(axes)])
        found = side.groupBy(_group_of(bounds)("block").alias("group"), "leaf")
        found = found.agg(low.alias("low"), high.alias("high"), F.max("reach").alias("reach")).toArrow()
        low, high = (matrix(found.column(c)).reshape(-1, axes) for c in ("low", "high"))
        return cls(bounds, np.asarray(found.column("group")), low, high, np.maximum(np.asarray(found.column("reach")), radius))


def _away(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """How far a box, or a point, is from each of many boxes."""
    gap = np.maximum(0.0, np.maximum(lows - high, low - highs))
    return np.sqrt((gap * gap).sum(axis=1))


def _overlap(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which groups of two dealings have numbers in common."""
    ends = [np.concatenate([[-np.inf], bounds, [np.inf]]) for bounds in (one, two)]
    return (ends[0][:-1, None] < ends[1][None, 1:]) & (ends[1][None, :-1] < ends[0][1:, None])


# Boxes that the rows of a block are compared with in one go, and bytes of rows that leave a task together.
_BOXES_AT_ONCE, _SENT_BYTES = 64, 4 << 20
# Rows of asking blocks that are compared in one go.
ASKING_ROWS = 1024


def _sent(
    side: DataFrame, own: np.ndarray, partners: _Boxes, asking: bool, radius: float, which: str, beside: bool
) -> DataFrame:
    """Blocks with the groups they are sent to, and of each the rows that are near enough to a box there."""
    overlap = _overlap(own, partners.bounds)
    binaries = ("ids", "vectors", "coordinates", "radii")

    def groups_of(row: dict) -> Iterator[dict]:
        low, high = np.asarray(row["low"]), np.asarray(row["high"])
        at = np.frombuffer(row["coordinates"], "<f8").reshape(row["n"], -1)
        looks = np.maximum(np.frombuffer(row["radii"], "<f8"), radius) if asking else np.zeros(row["n"])
        # The rows of an asking block look within distances of their own, the others as far as the asking block does.
        reach = np.full(len(partners.group), radius) if asking else partners.reach
        away = _away(low, high, partners.low, partners.high)
        group = int(np.searchsorted(own, row["block"]))
        near = away <= (np.maximum(row["reach"], radius) if asking else reach) + SLACK
        if which == ONCE:
            near &= partners.group <= group if asking else partners.group >= group
        if beside:
            near &= partners.group == np.searchsorted(partners.bounds, row["block"]) if asking else overlap[group, partners.group]
        near = np.flatnonzero(near)
        near = near[np.argsort(away[near], kind="stable")]
        for partner in np.unique(partners.group[near]).tolist():
            there = near[partners.group[near] == partner]
            kept = np.zeros(row["n"], bool)
            for first in range(0, len(there), _BOXES_AT_ONCE):
                rest = np.flatnonzero(~kept)
                if not len(rest):
                    break
                some = there[first : first + _BOXES_AT_ONCE]
                here = at[rest][:, None]
                gap = np.maximum(0.0, np.maximum(partners.low[some] - here, here - partners.high[some]))
                limit = np.maximum(looks[rest][:, None], reach[some]) + SLACK
                kept[rest] = (np.sqrt((gap * gap).sum(axis=2)) <= limit).any(axis=1)
            if not kept.any():
                continue
            cut = {} if kept.all() else {c: _cut(row[c], row["n"], kept) for c in binaries} | {"n": int(kept.sum())}
            ga, gb = (group, partner) if asking else (partner, group)
            yield row | cut | {"ga": ga, "gb": gb, "asking": asking}

    schema = T.StructType([side.schema[c] for c in ("block", "n", *binaries, "low", "high", "reach")])
    schema = schema.add("ga", T.IntegerType()).add("gb", T.IntegerType()).add("asking", T.BooleanType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for row in groups_of(batch.slice(k, 1).to_pylist()[0]):
                    held.append(row)
                    size += sum(len(row[c]) for c in binaries)
                    if size >= _SENT_BYTES:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return side.mapInArrow(run, schema)


def meet(
    askers: DataFrame,
    others: DataFrame,
    layout: Layout,
    which: str,
    kernel: Callable[[Block, Iterable[Block]], pa.Table],
    schema: str,
    radius: float = 0.0,
    unpack: Callable | None = None,
    beside: bool = False,
) -> DataFrame:
    """Every block ``a`` against those ``b`` that lie within its reach, or within ``radius`` if that is more.

    The pairs are those of :func:`meetings`, of blocks made by :func:`pack`, but they are never listed: their number grows with
    the square of the blocks. Both sides are dealt into groups as by :func:`across`. The boxes of all leaves are known everywhere,
    so that each block tells by itself which groups it is sent to, and with which rows; a task, which holds two
    groups, finds the pairs among them. Neighbouring askers are put together to ``ASKING_ROWS`` rows, unless ``unpack``
    makes something else than a :class:`Block` of a packed one. ``beside`` is for a first look, where both sides have the
    same numbers: a block meets only the group of ``GROUP_BYTES`` that its number falls in.
    """
    sides, measured, dealt = _measured(askers, others)
    if beside:
        (n_a, _), (_, bytes_b) = measured[0], measured[-1]
        wanted = 4 * askers.sparkSession.sparkContext.defaultParallelism
        dealt = (max(dealt[0], min(wanted, n_a)), max(1, -(-bytes_b // GROUP_BYTES)))
    found = [
        _Boxes.of(side, size, total, parts, layout, radius)
        for side, size, (_, total), parts in zip((askers, others), sides, measured, dealt)
    ]
    boxes_a, boxes_b = found[0], found[-1]
    if askers is not others:
        boxes_a, boxes_b = found
    left = _sent(askers, boxes_a.bounds, boxes_b, True, radius, which, beside)
    right = _sent(others, boxes_b.bounds, boxes_a, False, radius, which, beside)
    make = unpack or Block.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asking, numbers = np.asarray(table.column("asking")), np.asarray(table.column("block"))
        low, high = (matrix(table.column(c)) for c in ("low", "high"))
        reach = np.maximum(np.asarray(table.column("reach")), radius)
        order = np.argsort(numbers, kind="stable")
        here, there = order[asking[order]], order[~asking[order]]
        if not len(here) or not len(there):
            return
        made = [make(table.slice(k, 1).to_pylist()[0]) for k in there.tolist()]
        names = numbers[there]

        def answers(block, near: np.ndarray) -> Iterator[pa.RecordBatch]:
            if near.any():
                yield from kernel(block, [made[k] for k in np.flatnonzero(near).tolist()]).combine_chunks().to_batches()

        held, rows = [], 0
        for place, k in enumerate(here.tolist()):
            near = _away(low[k], high[k], low[there], high[there]) <= reach[k] + SLACK
            if which != ALL:
                near &= names < numbers[k] if which == ONCE else names != numbers[k]
            held.append((make(table.slice(k, 1).to_pylist()[0]), near, numbers[k]))
            if unpack:
                yield from answers(*held.pop()[:2])
                continue
            rows += len(held[-1][0].ids)
            if rows < ASKING_ROWS and len(held) < CHUNK_BLOCKS and place + 1 < len(here):
                continue
            # What some of them must not meet, since the rule goes by the number, they meet one by one.
            among = np.zeros(len(names), bool)
            if which != ALL and len(held) > 1:
                among = (names >= held[0][2]) & (names <= held[-1][2])
                for block, near, _ in held:
                    yield from answers(block, near & among)
            yield from answers(_together([b for b, _, _ in held]), np.any([n for _, n, _ in held], axis=0) & ~among)
            held, rows = [], 0

    groups_a, groups_b = len(boxes_a.bounds) + 1, len(boxes_b.bounds) + 1
    tasks = groups_a * groups_b if which != ONCE else groups_a * (groups_a + 1) // 2
    rows = left.unionByName(right).repartition(_partitions(askers.sparkSession, tasks), "ga", "gb")
    return rows.groupBy("ga", "gb").applyInArrow(run, schema)
