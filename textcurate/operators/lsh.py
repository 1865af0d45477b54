"""Approximate near-duplicate pairs, for callers who ask for them: signed random projections and an exact check.

The sides of random hyperplanes on which a vector lies are its bits; two vectors with angle t agree on a bit with probability
1 - t/pi. Bits are cut into bands, and vectors that agree on a whole band meet. There are as many bands as give a pair at
the threshold the wanted probability to meet; nearer pairs meet more surely, and every pair that is returned is
exact. Nothing in the library chooses this form by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textcurate.functions.vectors import RANK_DECIMALS, matrix, ranked, unit_rows
from textcurate.operators import blocks
from textcurate.operators.similarity import _best_pairs, _distinct_vectors, _is_zero, _pair_table
from textcurate.plans.scratch import discard, materialize

BITS = 16
BLOCK_ROWS = 1024
SEED = 11
# Bytes of vectors that are posted at a time; at least one band is.
ROUND_BYTES = 1536 << 20
_PAIRS = "a bigint, b bigint, similarity double"


def bands_for(threshold: float, recall: float, bits: int = BITS) -> int:
    """Bands of ``bits`` bits with which a pair at the threshold meets with at least probability ``recall``."""
    if not (0 < threshold <= 1 and 0 < recall < 1 and 1 <= bits <= 62):
        raise ValueError(f"threshold {threshold} and recall {recall} must lie between 0 and 1, bits {bits} between 1 and 62")
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def signatures(units: np.ndarray, bands: int, bits: int, seed: int = SEED) -> np.ndarray:
    """A number per row and band. The hyperplanes follow from the seed and the dimension."""
    planes = np.random.default_rng([seed, units.shape[1]]).normal(size=(units.shape[1], bands * bits))
    sides = (units @ planes > 0).reshape(len(units), bands, bits)
    return sides @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _postings(points: DataFrame, bands: int, bits: int, posted: range | None = None) -> DataFrame:
    """``(band, key, id, vector, bands)``: each row under each of its bands, or those of ``posted``."""
    posted = posted or range(bands)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vectors = matrix(part.column("vec"))
                keys = signatures(unit_rows(vectors), bands, bits)
                row = np.repeat(np.arange(len(vectors)), len(posted))
                packed = [v.tobytes() for v in vectors.astype("<f4")]
                signed = [k.tobytes() for k in keys.astype("<i8")]
                columns = [
                    pa.array(np.tile(posted, len(vectors)), pa.int32()),
                    pa.array(keys[:, posted].ravel(), pa.int64()),
                    part.column("id").take(pa.array(row)),
                    pa.array([packed[r] for r in row.tolist()], pa.binary()),
                    pa.array([signed[r] for r in row.tolist()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["band", "key", "id", "vector", "bands"])

    schema = "band int, key bigint, id bigint, vector binary, bands binary"
    return points.select("id", "vec").mapInArrow(post, schema)


@dataclass(frozen=True)
class _BucketBlock:
    """Rows of whole buckets, or a part of the rows of one large bucket, by band, key and id."""

    band: np.ndarray
    key: np.ndarray
    ids: np.ndarray
    units: np.ndarray
    bands: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _BucketBlock:
        n = row["n"]
        band, key, ids = (np.frombuffer(row[c], "<i8") for c in ("band", "key", "ids"))
        vectors = np.frombuffer(row["vectors"], "<f4").astype(np.float64).reshape(n, -1)
        return cls(band, key, ids, unit_rows(vectors), np.frombuffer(row["bands"], "<i8").reshape(n, -1))

    def buckets(self) -> Iterator[slice]:
        edges = np.flatnonzero((np.diff(self.band) != 0) | (np.diff(self.key) != 0)) + 1
        for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(self.ids)]):
            yield slice(first, last)


def _packed(postings: DataFrame, block_rows: int) -> DataFrame:
    """One stored row per block. Buckets of one row are gone; small buckets share a block, large ones have several."""
    postings = materialize(postings, "band-postings")
    sizes = postings.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "buckets")
    small = sizes.filter(F.col("n") <= block_rows).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = max(1, small // block_rows)
    bucket = F.xxhash64("band", "key")
    rows = postings.join(sizes, ["band", "key"])
    large = F.col("n") > block_rows
    # Blocks of large buckets are numbered beside those of small ones; what matters is that numbers differ.
    rows = rows.withColumns(
        {
            "bucket": F.when(large, bucket),
            "part": F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_rows))).otherwise(F.pmod(bucket, F.lit(shares))),
        }
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("band", "ascending"), ("key", "ascending"), ("id", "ascending")])
        one = {
            "bucket": table.column("bucket")[0].as_py(),
            "part": table.column("part")[0].as_py(),
            "n": len(table),
            "band": np.asarray(table.column("band"), "<i8").tobytes(),
            "key": np.asarray(table.column("key"), "<i8").tobytes(),
            "ids": np.asarray(table.column("id"), "<i8").tobytes(),
            "vectors": b"".join(table.column("vector").to_pylist()),
            "bands": b"".join(table.column("bands").to_pylist()),
            "size": table.nbytes,
        }
        return pa.Table.from_pylist([one], schema)

    binaries = [(c, pa.binary()) for c in ("band", "key", "ids", "vectors", "bands")]
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int32()), *binaries, ("size", pa.int64())])
    spark_schema = "bucket bigint, part bigint, n int, band binary, key binary, ids binary, vectors binary, bands binary, size bigint"
    rows = rows.select("bucket", "part", "band", "key", "id", "vector", "bands")
    packed = blocks.stored(rows.groupBy("bucket", "part").applyInArrow(run, spark_schema), "bucket-blocks", block_rows)
    discard(postings, "band-postings")
    return packed


# Pairs whose bands are compared in one go.
_PAIRS_AT_ONCE = 1 << 16


def _kernel(threshold: float, k: int) -> Callable[[_BucketBlock, Iterable[_BucketBlock]], pa.Table]:
    def verify(block: _BucketBlock, partners: Iterable[_BucketBlock]) -> pa.Table:
        none = np.zeros(0, np.int64)
        best, least = _pair_table(none, none, np.zeros(0), k), threshold
        for other in partners:
            # Partners of other blocks are parts of the same bucket.
            runs = [(x, x) for x in block.buckets()] if other is block else [(slice(None), slice(None))]
            held = [best]
            for x, y in runs:
                left, right = block.ids[x], other.ids[y]
                cosines = block.units[x] @ other.units[y].T
                near = cosines >= least - 10.0**-RANK_DECIMALS
                near &= left[:, None] < right[None, :] if other is block else left[:, None] != right[None, :]
                i, j = np.nonzero(near)
                # A pair is taken in the first band that it agrees on.
                band = int(block.band[x][0])
                for at in range(0, len(i), _PAIRS_AT_ONCE):
                    one, two = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
                    first = np.round(cosines[one, two], RANK_DECIMALS) >= least
                    for earlier in range(band):
                        first &= block.bands[x, earlier][one] != other.bands[y, earlier][two]
                    one, two = one[first], two[first]
                    if len(one):
                        a, b = left[one], right[two]
                        held.append(_pair_table(np.minimum(a, b), np.maximum(a, b), cosines[one, two], k))
            every = pa.concat_tables(held)
            best = _pair_table(*(np.asarray(every.column(c)) for c in ("a", "b", "similarity")), k)
            if len(best) == k:
                least = max(least, float(np.round(best.column("similarity")[-1].as_py(), RANK_DECIMALS)))
        return best

    return verify


def near_duplicates_approximate(
    rows: DataFrame,
    threshold: float = 0.95,
    top_k: int = 50,
    recall: float = 0.95,
    bits: int = BITS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Of the pairs with cosine ``>= threshold``, those that meet, best first: ``(row_a < row_b, similarity)``, ``top_k`` of them.

    Each pair at the threshold is found with probability ``recall`` or more, nearer ones with a higher one. Copies of a
    vector beyond the ``top_k + 1`` lowest row indices are left out, since they cannot be among the answers; zero
    vectors have no bits and no pairs. A bucket of any size is cut into blocks, each of which meets the others once.
    """
    bands = bands_for(threshold, recall, bits)
    if top_k < 1:
        return rows.sparkSession.createDataFrame([], "row_a bigint, row_b bigint, similarity double")
    points = materialize(_distinct_vectors(rows, top_k + 1).filter(~_is_zero(F.col("vec"))).select("id", "vec"), "points")
    count, dim = points.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    # What is stored and shipped for a band is deleted before the next ones are taken, so that it is not there for all at once.
    at_once = max(1, ROUND_BYTES // max(1, count * (4 * dim + 8 * bands)))
    best = None
    for first in range(0, bands, at_once):
        posted = range(first, min(bands, first + at_once))
        packed = _packed(_postings(points, bands, bits, posted), block_rows)
        found = _pairs_in(packed, _kernel(threshold, top_k), block_rows)
        if best is not None:
            found = found.unionByName(best.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"), "similarity"))
        last, best = best, materialize(_best_pairs(found, top_k), "best-pairs")
        discard(packed, "bucket-blocks")
        if last is not None:
            discard(last, "best-pairs")
        seen, worst = best.agg(F.count("*"), F.min(ranked(F.col("similarity")))).first()
        if seen == top_k and worst > threshold:
            threshold = worst
    return best.orderBy(ranked(F.col("similarity")).desc(), "row_a", "row_b")


def _pairs_in(packed: DataFrame, kernel: Callable, block_rows: int) -> DataFrame:
    """The best pairs of each block, and of each two parts of a large bucket."""
    found = blocks.within(packed, kernel, _PAIRS, _BucketBlock.of)
    # Only parts of large buckets have partners. They are numbered bucket by bucket, so that few groups of them meet.
    large = packed.filter("bucket IS NOT NULL")
    numbers = large.select("bucket", "part").withColumn("block", F.row_number().over(Window.orderBy("bucket", "part")).cast("bigint"))
    numbers = materialize(numbers, "block-numbers")
    if numbers.isEmpty():
        return found
    parts = numbers.select("bucket", "block")
    pairs = parts.withColumnRenamed("block", "a").join(parts.withColumnRenamed("block", "b"), "bucket").filter("a > b")
    pairs = materialize(pairs.select("a", "b"), "meetings")
    sent = large.join(F.broadcast(numbers), ["bucket", "part"]).drop("bucket", "part")
    return found.unionByName(blocks.across(sent, sent, pairs, kernel, _PAIRS, _BucketBlock.of))
