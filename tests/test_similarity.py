"""Pairs, neighbours, outliers and search against brute force, in the one-block and the many-cells plan."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textcurate.operators import blocks, similarity
from textcurate.operators.embed import HashedEmbedder
from textcurate.schema import ROW_INDEX, VECTOR

DIM = 6
# One block; several blocks, each with each; cells.
PLANS = [(1000, 16), (40, 16), (16, 0)]


def random_rows(seed, n=180, copies=60, zeros=12, tight=40):
    """Clusters, a third of all rows equal, a tight bunch, near copies, and rows without direction."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, DIM))
    rows = centers[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, DIM))
    rows[:copies] = rows[0]
    rows[copies : copies + tight] = rows[copies] + 1e-3 * rng.normal(size=(tight, DIM))
    rows[n - zeros :] = 0
    return rows[rng.permutation(n)].astype(np.float32)


def cosines(rows):
    wide = rows.astype(np.float64)
    units = wide / (np.linalg.norm(wide, axis=1, keepdims=True) + 1e-12)
    return units @ units.T


def frame(spark, rows):
    data = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, f"{ROW_INDEX} bigint, {VECTOR} array<float>")


def expected_pairs(rows, threshold, k):
    i, j = np.triu_indices(len(rows), 1)
    s = np.round(cosines(rows)[i, j], 9) if len(rows) else np.zeros(0)
    keep = s >= threshold
    i, j, s = i[keep], j[keep], s[keep]
    order = np.lexsort((j, i, -s))[:k]
    return list(zip(i[order].tolist(), j[order].tolist())), s[order]


def expected_neighbors(rows, n):
    scores = cosines(rows)
    np.fill_diagonal(scores, -np.inf)
    return scores, np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :n]


def check_pairs(spark, rows, threshold, k, block_rows, direct_blocks=0):
    found = similarity.near_duplicates(frame(spark, rows), threshold, k, block_rows, direct_blocks).collect()
    pairs, scores = expected_pairs(rows, threshold, k)
    assert [(r.row_a, r.row_b) for r in found] == pairs
    assert np.allclose([r.similarity for r in found], scores, atol=1e-8)


@pytest.mark.parametrize("block_rows,direct_blocks", PLANS)
@pytest.mark.parametrize("threshold,k", [(0.999, 50), (0.9, 3), (0.9, 400), (0.0, 100), (1.0, 2000)])
def test_pairs_equal_brute_force(spark, block_rows, direct_blocks, threshold, k):
    check_pairs(spark, random_rows(1), threshold, k, block_rows, direct_blocks)


@pytest.mark.parametrize("seed", [2, 3])
def test_pairs_in_many_cells_without_copies(spark, seed):
    check_pairs(spark, random_rows(seed, n=150, copies=1, zeros=0, tight=100), 0.95, 5000, 8)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_pairs_of_tiny_inputs(spark, n):
    check_pairs(spark, random_rows(4)[:n], -1.0, 10, 1000)


def test_threshold_is_inclusive(spark):
    rows = np.array([[1, 0], [0.6, 0.8], [0.8, 0.6]], dtype=np.float32)
    found = similarity.near_duplicates(frame(spark, rows), 0.96, 10).collect()
    assert [(r.row_a, r.row_b) for r in found] == [(1, 2)]


def test_pairs_do_not_depend_on_partitioning(spark):
    rows = random_rows(5)
    data = frame(spark, rows)
    one = similarity.near_duplicates(data.repartition(1), 0.9, 300, 16, 0).collect()
    many = similarity.near_duplicates(data.repartition(7, F.rand(3)), 0.9, 300, 16, 0).collect()
    assert [(r.row_a, r.row_b) for r in one] == [(r.row_a, r.row_b) for r in many]


@pytest.mark.parametrize("block_rows,direct_blocks", PLANS)
@pytest.mark.parametrize("n", [1, 4])
def test_neighbors_equal_brute_force(spark, block_rows, direct_blocks, n):
    rows = random_rows(6)
    found = similarity.knn(frame(spark, rows), n, block_rows, direct_blocks).collect()
    scores, nearest = expected_neighbors(rows, n)
    assert len(found) == len(rows) * n
    for r in found:
        assert nearest[r.row_index, r["rank"] - 1] == r.neighbor
        assert abs(scores[r.row_index, r.neighbor] - r.similarity) < 1e-9


def test_neighbors_when_there_are_fewer_rows_than_wanted(spark):
    found = similarity.knn(frame(spark, random_rows(7)[:3]), 5).collect()
    assert len(found) == 6


@pytest.mark.parametrize("block_rows,direct_blocks", PLANS)
@pytest.mark.parametrize("top_k,n", [(10, 5), (180, 3), (2, 500)])
def test_outliers_equal_brute_force(spark, block_rows, direct_blocks, top_k, n):
    rows = random_rows(8)
    found = similarity.find_outliers(frame(spark, rows), top_k, n, block_rows, direct_blocks).collect()
    scores, _ = expected_neighbors(rows, 1)
    n = max(1, min(n, len(rows) - 1))
    isolation = 1 - np.sort(scores, axis=1)[:, -n:].mean(axis=1)
    order = np.lexsort((np.arange(len(rows)), -np.round(isolation, 9)))[:top_k]
    assert [r.row_index for r in found] == order.tolist()
    assert np.allclose([r.outlier_score for r in found], isolation[order], atol=1e-9)


def test_first_batch_rules_out_the_rest(spark, monkeypatch):
    """With a first batch smaller than the data, the second step has to add what the first one missed."""
    rows = random_rows(9, n=300, copies=1, zeros=3, tight=20)
    monkeypatch.setattr(similarity, "FIRST_BATCH", 4)
    found = similarity.find_outliers(frame(spark, rows), 4, 5, 16, 0).collect()
    scores, _ = expected_neighbors(rows, 1)
    isolation = 1 - np.sort(scores, axis=1)[:, -5:].mean(axis=1)
    order = np.lexsort((np.arange(len(rows)), -np.round(isolation, 9)))[:4]
    assert [r.row_index for r in found] == order.tolist()


def test_senseless_arguments_are_rejected(spark):
    data = frame(spark, random_rows(9)[:4])
    for call in (
        lambda: similarity.knn(data, 0),
        lambda: similarity.find_outliers(data, 3, -1),
        lambda: similarity.near_duplicates(data, 1.5),
        lambda: similarity.near_duplicates(data, float("nan")),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("n", [0, 1])
def test_outliers_need_two_rows(spark, n):
    assert similarity.find_outliers(frame(spark, random_rows(9)[:n])).collect() == []


def test_search_orders_by_score_then_index(spark):
    rows = random_rows(10)
    query = rows[3].tolist()
    found = similarity.search(frame(spark, rows), query, 7).collect()
    scores = np.round(cosines(np.vstack([rows, rows[3:4]]))[-1, :-1], 9)
    order = np.lexsort((np.arange(len(rows)), -scores))[:7]
    assert [r[ROW_INDEX] for r in found] == order.tolist()


@pytest.mark.parametrize("k,expected", [(0, 0), (-1, 0), (1000, 180)])
def test_search_bounds(spark, k, expected):
    assert similarity.search(frame(spark, random_rows(10)), [1.0] * DIM, k).count() == expected


def test_blocks_stay_small_when_all_rows_are_close(spark):
    """A bunch with no structure at all still ends in tasks of bounded size."""
    rng = np.random.default_rng(11)
    rows = (np.ones(DIM) + 1e-4 * rng.normal(size=(200, DIM))).astype(np.float32)
    check_pairs(spark, rows, 0.99, 40, 16)


def test_boxes_rule_out_half_of_the_block_pairs(spark):
    """Hashed documents at 0.95: fewer than half of all pairs of blocks meet, and no near pair is lost."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not there")
    texts = sorted({r[0] for r in spark.read.parquet(path).select("text").collect()})
    rows = np.asarray(HashedEmbedder(256)(texts), np.float32)
    points = similarity._distinct_vectors(frame(spark, rows), 1)
    layout = blocks.make_layout(points, len(rows), 16)
    located = blocks.locate(points, layout, 16)
    packed = blocks.pack(located, layout)
    n = packed.count()
    near = packed.withColumn("reach", F.lit(float(np.sqrt(2 - 2 * 0.95))))
    pairs = {(r.a, r.b) for r in blocks.meetings(near, packed, layout, blocks.ONCE).collect()}
    assert n > 50 and all(a > b for a, b in pairs) and len(pairs) < n * (n - 1) / 2 / 2
    block = {r.id: r.block for r in located.collect()}
    i, j = np.nonzero(np.triu(cosines(rows) >= 0.95, 1))
    wanted = {(max(block[a], block[b]), min(block[a], block[b])) for a, b in zip(i.tolist(), j.tolist()) if a in block and b in block}
    assert {(a, b) for a, b in wanted if a != b} <= pairs
    both = {(r.a, r.b) for r in blocks.meetings(near, packed, layout, blocks.OTHERS).collect()}
    assert both == pairs | {(b, a) for a, b in pairs}


def test_meetings_are_those_of_near_boxes(spark):
    """The descent from the root finds what comparing all boxes finds, in leaves of several blocks too."""
    rng = np.random.default_rng(3)
    rows = random_rows(12, n=400, copies=1, zeros=0, tight=150)
    points = similarity._distinct_vectors(frame(spark, rows), 1)
    layout = blocks.make_layout(points, 400, 50)
    packed = blocks.pack(blocks.locate(points, layout, 6).withColumn("radius", F.rand(int(rng.integers(99)))), layout)
    boxes = packed.collect()
    assert len({r.leaf for r in boxes}) < len(boxes) and sum(r.n for r in boxes) == 400
    low, high = np.array([r.low for r in boxes]), np.array([r.high for r in boxes])
    gaps = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    away = np.sqrt((gaps**2).sum(axis=2))
    expected = {
        (a.block, b.block)
        for i, a in enumerate(boxes)
        for j, b in enumerate(boxes)
        if i != j and away[i, j] <= a.reach + blocks.SLACK
    }
    assert {(r.a, r.b) for r in blocks.meetings(packed, packed, layout, blocks.OTHERS).collect()} == expected


@pytest.mark.parametrize("block_rows,direct_blocks", PLANS)
@pytest.mark.parametrize("k", [1, 7, 500])
def test_many_queries_equal_brute_force(spark, block_rows, direct_blocks, k):
    """Queries that are rows, or none; a third of them equal, some without direction; ids that are null or repeated."""
    rows = random_rows(13)
    rng = np.random.default_rng(14)
    asked = np.vstack([rows[:30], rng.normal(size=(40, DIM)), np.repeat(rows[:1], 40, axis=0), np.zeros((3, DIM))]).astype(np.float32)
    ids = [None if i % 20 == 0 else i // 2 for i in range(len(asked))]
    queries = spark.createDataFrame(
        [(q, [float(x) for x in v], "x") for q, v in zip(ids, asked)], f"query_id bigint, {VECTOR} array<float>, score string"
    )
    found = similarity.search_many(frame(spark, rows), queries, k, block_rows, direct_blocks).collect()
    scores = cosines(np.vstack([asked, rows]))[: len(asked), len(asked) :]
    expected = []
    for q, row in zip(ids, scores):
        best = np.lexsort((np.arange(len(rows)), -np.round(row, 9)))[:k]
        expected += [(q, rank + 1, int(i), round(float(row[i]), 7)) for rank, i in enumerate(best)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.query_id, r["rank"], r.row_index, round(r.score, 7) + 0.0) for r in found]
    assert sorted(((q, k, i) for q, k, i, _ in got), key=key) == sorted(((q, k, i) for q, k, i, _ in expected), key=key)
    assert np.allclose([r[3] for r in sorted(got, key=key)], [r[3] for r in sorted(expected, key=key)], atol=1e-6)


def test_many_queries_of_tiny_tables(spark):
    rows = frame(spark, random_rows(13)[:2])
    queries = spark.createDataFrame([(1, [1.0] * DIM)], f"query_id bigint, {VECTOR} array<float>")
    assert similarity.search_many(rows, queries, 0).count() == 0
    assert similarity.search_many(rows.limit(0), queries, 3).count() == 0
    assert similarity.search_many(rows, queries.limit(0), 3).count() == 0
    assert similarity.search_many(rows, queries, 3).count() == 2


def test_a_block_is_shipped_to_groups_and_not_to_partners(spark):
    """100 blocks that all meet: few tasks, each of which gets a block once, whatever the number of its partners."""
    rng = np.random.default_rng(15)
    points = similarity._distinct_vectors(frame(spark, rng.normal(size=(700, DIM)).astype(np.float32)), 1)
    layout = blocks.make_layout(points, 700, 7)
    packed = blocks.pack(blocks.locate(points, layout, 7).withColumn("radius", F.lit(blocks.FAR)), layout)
    pairs = blocks.meetings(packed, packed, layout, blocks.OTHERS)

    def seen(block, partners):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        return pa.table([(pa.array([task] * len(partners), pa.int64())), [int(p.ids[0]) for p in partners], [int(block.ids[0])] * len(partners)], ["task", "b", "a"])

    met = blocks.across(packed, packed, pairs, seen, "task bigint, b bigint, a bigint").collect()
    n = packed.count()
    assert n > 90 and len({(r.a, r.b) for r in met}) == len(met) == n * (n - 1)
    wanted = 4 * spark.sparkContext.defaultParallelism
    assert len({(r.task, r.b) for r in met}) <= n * wanted**0.5 * 1.5
    assert max(r.task for r in met) < 4 * wanted


def test_partners_are_joined_without_loss(monkeypatch):
    """Small partners are compared in one go; a row far from all their boxes stays out."""
    rng = np.random.default_rng(16)
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 25)
    rows = rng.normal(size=(60, DIM))
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    parts = [slice(k, k + 10) for k in range(0, 60, 10)]
    made = [
        blocks.Block(np.arange(60)[p], units[p], units[p], np.full(10, 1.0), units[p].min(axis=0)[None], units[p].max(axis=0)[None])
        for p in parts
    ]
    groups = list(blocks.joined(made))
    assert [len(g.ids) for g in groups] == [20, 20, 20] and np.concatenate([g.ids for g in groups]).tolist() == list(range(60))
    assert np.allclose(made[5].distances_to(groups[0]), np.minimum(made[5].distances_to(made[0]), made[5].distances_to(made[1])))
    found = similarity._block_neighbor_kernel(3)(made[5], made[:5]).to_pylist()
    scores = units[50:] @ units[:50].T
    expected = {(50 + q, int(o)) for q in range(10) for o in np.argsort(-scores[q])[:3] if scores[q, o] >= 0.5}
    assert {(r["id"], r["other"]) for r in found} == expected


@pytest.mark.parametrize("radius", [0.02, blocks.FAR])
def test_only_rows_near_a_partner_are_shipped(spark, radius):
    """Rows away from all boxes of a block's partners stay where they are, and no row within the radius of another does."""
    rng = np.random.default_rng(17)
    rows = rng.normal(size=(600, DIM)).astype(np.float32)
    points = similarity._bounded_copies(frame(spark, rows), 5)
    layout = blocks.make_layout(points, 600, 20)
    packed = blocks.pack(blocks.locate(points, layout, 20), layout)
    pairs = blocks.meetings(packed.withColumn("reach", F.lit(radius)), packed, layout, blocks.ONCE)

    def seen(block, partners):
        met = [(int(i), int(j)) for p in partners for i in block.ids for j in p.ids]
        return pa.table([[i for i, _ in met], [j for _, j in met]], pa.schema([("i", pa.int64()), ("j", pa.int64())]))

    met = {frozenset(r) for r in blocks.across(packed, packed, pairs, seen, "i bigint, j bigint", radius=radius).collect()}
    home = {r.id: r.block for r in blocks.locate(points, layout, 20).collect()}
    every = [(i, j) for i in range(600) for j in range(i) if home[i] != home[j]]
    away = np.sqrt(np.maximum(0, 2 - 2 * cosines(rows)))
    assert {frozenset(p) for p in every if away[p] <= radius} <= met
    assert len(met) == len(every) if radius == blocks.FAR else len(met) < len(every) / 20


def test_vectors_with_few_copies_are_not_moved(spark):
    rows = np.repeat(np.random.default_rng(18).normal(size=(40, DIM)), 3, axis=0).astype(np.float32)
    few = similarity._bounded_copies(frame(spark, rows), 3)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in few.collect()) == list(range(120))
    rows[60:] = rows[0]
    cut = similarity._bounded_copies(frame(spark, rows), 4)
    assert sorted(r.id for r in cut.collect()) == [*range(60), 60]


def test_many_crowded_vectors(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CROWDED", 2)
    rows = np.repeat(np.random.default_rng(19).normal(size=(10, DIM)), 6, axis=0).astype(np.float32)
    assert sorted(r.id for r in similarity._bounded_copies(frame(spark, rows), 2).collect()) == [i for i in range(60) if i % 6 < 2]


def test_pairs_of_blocks_are_not_listed(spark, monkeypatch):
    """Their number grows with the square of the blocks; groups meet, and a task finds the pairs among its two."""

    def refused(*_, **__):
        raise AssertionError("the pairs of blocks are listed")

    monkeypatch.setattr(blocks, "meetings", refused)
    monkeypatch.setattr(blocks, "ASKING_ROWS", 30)
    rows = random_rows(31, n=240)
    queries = frame(spark, rows).withColumnRenamed(ROW_INDEX, "query_id")
    found = similarity.search_many(frame(spark, rows), queries, 4, block_rows=8, direct_blocks=0).collect()
    order = np.argsort(-np.round(cosines(rows), 9), axis=1, kind="stable")[:, :4]
    by = {(r.query_id, r["rank"]): r.row_index for r in found}
    assert by == {(q, k + 1): int(order[q, k]) for q in range(240) for k in range(4)}
    check_pairs(spark, rows, 0.97, 500, 8)


def test_a_row_that_has_found_enough_looks_no_further():
    rng = np.random.default_rng(32)
    units = rng.normal(size=(90, DIM))
    units[:60] = units[0] + 1e-3 * rng.normal(size=(60, DIM))
    units /= np.linalg.norm(units, axis=1, keepdims=True)

    def block(ids):
        at = units[ids]
        return blocks.Block(ids, at, at, np.full(len(ids), blocks.FAR), at.min(axis=0)[None], at.max(axis=0)[None])

    def partners():
        for first in range(20, 60, 20):
            yield block(np.arange(first, first + 20))
        raise AssertionError("all rows have near ones by now")

    at_once = blocks.CHUNK_BLOCKS
    try:
        blocks.CHUNK_BLOCKS = 1
        found = similarity._block_neighbor_kernel(4, 0.9)(block(np.arange(20)), partners())
    finally:
        blocks.CHUNK_BLOCKS = at_once
    assert sorted(set(found.column("id").to_pylist())) == list(range(20))
    assert min(found.column("cosine").to_pylist()) > 0.9


@pytest.mark.parametrize("group_bytes", [4 << 10, 32 << 20])
def test_outliers_that_look_beside_first_equal_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(similarity, "FIRST_BATCH", 12)
    monkeypatch.setattr(blocks, "GROUP_BYTES", group_bytes)
    looks = []
    complete = similarity._NeighborSearch.complete
    monkeypatch.setattr(
        similarity._NeighborSearch, "complete", lambda self, *a, **b: looks.append(b.get("beside", False)) or complete(self, *a, **b)
    )
    rng = np.random.default_rng(33)
    rows = np.vstack([rng.normal(size=(300, DIM)), random_rows(34, n=160)]).astype(np.float32)
    found = similarity.find_outliers(frame(spark, rows), 3, 4, 8, 0).collect()
    scores, near = expected_neighbors(rows, 4)
    outlier = 1 - np.take_along_axis(scores, near, axis=1).mean(axis=1)
    assert np.allclose([r.outlier_score for r in found], np.sort(outlier)[::-1][:3], atol=1e-8)
    assert True in looks
