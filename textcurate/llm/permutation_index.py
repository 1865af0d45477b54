"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. An index block holds some thousand vectors and, per pivot, an
inverted file of the vectors that have it among their nearest, with its place. A query adds up what the files of its own
pivots tell about the footrule distance of the orders, ranks each block's vectors by it, and reranks the best share by
exact distance. Blocks are random parts of the table, so each block's share is the same share of the whole.

Equal vectors are one entry of the index, under the smallest of their ids, so that the share is one of different vectors
however many rows a vector has. A found entry stands for the smallest ids of its members, as many as an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textcurate.operators.blocks import across
from textcurate.plans.scratch import materialize

_PACKED = (
    "block int, members binary, counts binary, sizes binary, vectors binary, owners binary, places binary, ends binary, size bigint"
)


def usable(vector: Column) -> Column:
    """No null, no null or non-finite component, and not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part, in double precision."""
    vector = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``(vector, id, members, counts)``: every different vector with the smallest ids that have it, ``id`` the first.

    ``k + 1`` different ids with up to ``k`` rows each are all that an answer of ``k`` can hold, the asking id left out. The
    limit is applied before the exchange, so a vector that many rows have does not gather them in one task.
    """
    counted = rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = counted.withColumn("place", place).filter(F.col("place") <= k + 1)
    found = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("found"))
    return found.select(
        "vector", F.col("found")[0]["id"].alias("id"), F.col("found.id").alias("members"), F.col("found.n").alias("counts")
    )


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Up to ``pivots`` different vectors of a sample of four times as many rows, chosen by a hash of the id."""
    sample = rows.orderBy(F.xxhash64(F.lit("pivot"), "id"), "id", "vector").limit(4 * pivots).collect()
    different = {tuple(r["vector"]): None for r in sample}
    return np.array(list(different)[:pivots], np.float64)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Per vector the numbers of its ``length`` nearest pivots, nearest first, ties to the smaller number."""
    square = (pivots * pivots).sum(axis=1) / 2 - vectors @ pivots.T
    return np.argsort(square, axis=1, kind="stable")[:, :length]


def _pack(block: int, group: pd.DataFrame, pivots: np.ndarray, length: int) -> pd.DataFrame:
    vectors = np.stack(group["vector"].to_numpy())
    order = np.lexsort((*vectors.T[::-1], group["id"].to_numpy(np.int64)))
    vectors = vectors[order]
    members, counts = ([column.iloc[k] for k in order] for column in (group["members"], group["counts"]))
    near = nearest_pivots(vectors, pivots, length)
    flat = near.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    row = {
        "block": [block],
        "members": [np.concatenate(members).astype("<i8").tobytes()],
        "counts": [np.concatenate(counts).astype("<i4").tobytes()],
        "sizes": [np.array([len(m) for m in members], "<i4").tobytes()],
        "vectors": [vectors.astype("<f8").tobytes()],
        "owners": [(by_pivot // length).astype("<i4").tobytes()],
        "places": [(by_pivot % length).astype("<i4").tobytes()],
        "ends": [np.cumsum(np.bincount(flat, minlength=len(pivots))).astype("<i4").tobytes()],
    }
    row["size"] = [sum(len(column[0]) for name, column in row.items() if name != "block")]
    return pd.DataFrame(row)


def build(rows: DataFrame, pivots: Broadcast, length: int, blocks: int, label: str) -> DataFrame:
    """The index of ``(vector, id, members, counts)`` as a written table: one row per block, every vector in one."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _pack(int(key[0]), group, pivots.value, length)

    placed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int"))
    return materialize(placed.groupBy("block").applyInPandas(pack, _PACKED), label)


def _search(block: dict, queries: dict, pivots: np.ndarray, length: int, k: int, share: float, least: int):
    """The ``k`` nearest rows of a block's best share of vectors for each query: ``(query, id, distance)``, unordered."""
    members, counts = np.frombuffer(block["members"], "<i8"), np.frombuffer(block["counts"], "<i4")
    sizes, dimension = np.frombuffer(block["sizes"], "<i4"), pivots.shape[1]
    stops = np.cumsum(sizes)
    heads = stops - sizes
    first, second = members[heads], members[np.minimum(heads + 1, stops - 1)]
    vectors = np.frombuffer(block["vectors"], "<f8").reshape(-1, dimension)
    owners, places = np.frombuffer(block["owners"], "<i4"), np.frombuffer(block["places"], "<i4")
    ends = np.frombuffer(block["ends"], "<i4")
    starts = np.concatenate([[0], ends[:-1]])
    query_ids = np.frombuffer(queries["members"], "<i8")
    query_vectors = np.frombuffer(queries["vectors"], "<f8").reshape(-1, dimension)
    near = nearest_pivots(query_vectors, pivots, length)
    wanted = min(len(sizes), max(least, int(np.ceil(share * len(sizes)))))
    found = []
    for query, vector, order in zip(query_ids, query_vectors, near):
        # Half of what the footrule falls short of its largest value: larger is nearer.
        agreement = np.zeros(len(sizes), np.int32)
        for place, pivot in enumerate(order):
            file = slice(starts[pivot], ends[pivot])
            agreement[owners[file]] += length - np.maximum(places[file], place)
        own = first == query
        agreement[own & (sizes == 1)] = -1
        cut = np.partition(agreement, len(sizes) - wanted)[len(sizes) - wanted]
        chosen = np.flatnonzero(agreement > cut)
        level = np.flatnonzero(agreement == cut)[: wanted - len(chosen)]
        chosen = np.concatenate([chosen, level])
        chosen = chosen[agreement[chosen] >= 0]
        distance = np.sqrt(((vectors[chosen] - vector) ** 2).sum(axis=1))
        # Each vector has a row to give, so the first k by their smallest id hold the first k rows.
        best = np.lexsort((np.where(own, second, first)[chosen], distance))[:k]
        chosen, distance = chosen[best], distance[best]
        places_of = [np.arange(heads[c], stops[c]) for c in chosen]
        rows = np.concatenate([np.empty(0, np.int64), *places_of])
        times = counts[rows] * (members[rows] != query)
        ids = np.repeat(members[rows], times)
        distance = np.repeat(np.repeat(distance, sizes[chosen]), times)
        best = np.lexsort((ids, distance))[:k]
        found.append((np.full(len(best), query), ids[best], distance[best]))
    return [np.concatenate(column) for column in zip(*found)]


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 10,
    pivots: int = 128,
    length: int = 64,
    share: float = 0.15,
    least: int = 200,
    block_rows: int = 8192,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, id, score)``: up to ``k`` nearest other rows of each row for which ``queries`` holds.

    ``score`` is the Euclidean distance of the original vectors in double precision; nearest first, ties to the smaller
    id. Every different usable vector is indexed; pivots come from a sample of ``4 * pivots`` of them. Of each block the
    ``share`` of smallest footrule distance, ``least`` at least, is reranked. Vectors that are null, zero or hold a null or
    non-finite component, rows with a null id, and vectors of another than the most frequent length take no part. Rows that
    repeat an id are candidates each, but not of their own id; of several vectors under an id that asks, the least one
    asks (compared component by component).
    """
    spark = table.sparkSession
    rows = vectors_of(table, id_column, vector_column)
    shape = "query_id long, vec_id long, score double"
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return empty.withColumnRenamed("vec_id", id_column)
    rows = rows.filter(F.size("vector") == lengths[0]["d"])
    rows = materialize(distinct_vectors(rows, k), "distinct-vectors")
    blocks = -(-rows.count() // block_rows)
    chosen = choose_pivots(rows.select("id", "vector"), pivots)
    length = min(length, len(chosen))
    shared = spark.sparkContext.broadcast(chosen)
    index = build(rows, shared, length, blocks, "permutation-index")
    asking = vectors_of(table.filter(queries), id_column, vector_column)
    asking = asking.filter(F.size("vector") == lengths[0]["d"]).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = asking.count()
    asking = asking.withColumns({"members": F.array("id"), "counts": F.array(F.lit(1))})
    packed = build(asking, shared, length, max(1, -(-asked // 2048)), "permutation-queries")
    # Each packed query block meets each index block. Both travel in groups of bounded size: the queries for all blocks of the
    # index grow with the square of the table, and a join on the block's number takes them for small and broadcasts them.
    numbers = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = packed.select(F.col("block").alias("a"), numbers.alias("b"))

    def search(asked_for: dict, partners: Iterable[dict]) -> pa.Table:
        parts = [_search(block, asked_for, shared.value, length, k, share, least) for block in partners]
        query, ids, distance = (np.concatenate(column) for column in zip(*parts))
        best = np.lexsort((ids, distance, query))
        query, ids, distance = query[best], ids[best], distance[best]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query_id": query[kept], "vec_id": ids[kept], "score": distance[kept]})

    found = across(packed, index, pairs, search, shape, dict)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
