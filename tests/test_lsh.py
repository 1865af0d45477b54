"""The approximate form: what it returns is exact, and it finds as many pairs as was asked for."""

import os
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_similarity import cosines, expected_pairs, frame, random_rows

from textcurate.operators import blocks, lsh
from textcurate.operators.embed import HashedEmbedder


def near_rows(seed, n=120, copies=4, dim=24, spread=0.3):
    """Groups of vectors with cosines around 0.95, among others."""
    rng = np.random.default_rng(seed)
    rows = np.repeat(rng.normal(size=(n, dim)), copies, axis=0)
    rows += spread * rng.normal(size=rows.shape) * 0.75
    return rows[rng.permutation(len(rows))].astype(np.float32)


def test_bands_follow_from_the_threshold_and_the_recall():
    for threshold in (0.5, 0.8, 0.95, 0.999):
        for recall in (0.5, 0.9, 0.99):
            agree = (1 - np.arccos(threshold) / np.pi) ** 16
            bands = lsh.bands_for(threshold, recall)
            assert 1 - (1 - agree) ** bands >= recall and (bands == 1 or 1 - (1 - agree) ** (bands - 1) < recall)
    assert lsh.bands_for(1.0, 0.999) == 1
    for wrong in ((0.0, 0.9), (0.9, 1.0), (0.9, 0.0), (float("nan"), 0.9)):
        with pytest.raises(ValueError):
            lsh.bands_for(*wrong)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bits_agree_as_often_as_the_angle_says(seed):
    rng = np.random.default_rng(seed)
    one, two = rng.normal(size=(2, 30))
    one, two = one / np.linalg.norm(one), two / np.linalg.norm(two)
    bits = lsh.signatures(np.array([one, two]), 3000, 1, seed)
    assert abs((bits[0] == bits[1]).mean() - (1 - np.arccos(one @ two) / np.pi)) < 0.04


@pytest.mark.parametrize("block_rows", [9, 1024])
@pytest.mark.parametrize("recall", [0.9, 0.99])
def test_recall_of_pairs_near_the_threshold(spark, block_rows, recall):
    rows = near_rows(4)
    found = lsh.near_duplicates_approximate(frame(spark, rows), 0.93, 10_000, recall, 8, block_rows).collect()
    pairs, scores = expected_pairs(rows, 0.93, 10_000)
    exact = dict(zip(pairs, scores))
    assert len({(r.row_a, r.row_b) for r in found}) == len(found) > 100
    assert all(abs(exact[r.row_a, r.row_b] - r.similarity) < 1e-8 for r in found)
    assert len(found) >= (recall - 0.03) * len(exact)


def test_hot_buckets_and_the_best_few(spark):
    """A third of the rows are equal, many more nearly so: the best pairs are exact ones, in order."""
    rows = random_rows(5, n=300, copies=100, tight=100)
    found = lsh.near_duplicates_approximate(frame(spark, rows), 0.99, 60, 0.9, 4, 16).collect()
    assert [(r.row_a, r.row_b) for r in found] == expected_pairs(rows, 0.99, 60)[0]


def test_tiny_tables(spark):
    rows = near_rows(6)
    for n in (0, 1):
        assert lsh.near_duplicates_approximate(frame(spark, rows[:n])).collect() == []
    assert lsh.near_duplicates_approximate(frame(spark, rows), top_k=0).collect() == []
    assert lsh.near_duplicates_approximate(frame(spark, np.zeros((5, 4), np.float32))).collect() == []


def test_recall_on_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not there")
    texts = [r[0] for r in spark.read.parquet(path).select("text").collect()]
    rows = np.asarray(HashedEmbedder(256)(texts), np.float32)
    exact = {tuple(p) for p in np.argwhere(np.triu(np.round(cosines(rows), 9) >= 0.95, 1)).tolist()}
    found = {(r.row_a, r.row_b) for r in lsh.near_duplicates_approximate(frame(spark, rows), 0.95, 100_000).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_a_block_of_near_copies_takes_little_memory():
    """Half a million pairs above the threshold in one block: their vectors are not put side by side."""
    rng = np.random.default_rng(7)
    rows = 1 + 0.01 * rng.normal(size=(1024, 256))
    same = np.zeros(1024, np.int64)
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    block = lsh._BucketBlock(same, same, np.arange(1024), units, np.zeros((1024, 15), np.int64))
    tracemalloc.start()
    found = lsh._kernel(0.95, 1000)(block, [block])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert list(zip(found["a"].to_pylist(), found["b"].to_pylist())) == expected_pairs(rows, 0.95, 1000)[0]


def test_blocks_are_stored_in_short_row_groups(spark):
    """A reader holds a whole row group of blocks of a megabyte each."""
    points = frame(spark, near_rows(8, n=400)).selectExpr("_row_index AS id", "_embedding AS vec")
    packed = lsh._packed(lsh._postings(points, 4, 12), 2).coalesce(1)
    assert packed.count() > 100
    files = blocks.stored(packed, "again", 1024).inputFiles()
    found = [pq.ParquetFile("/" + f.removeprefix("file:").lstrip("/")).metadata for f in files]
    assert max(m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)) <= 16


@pytest.mark.parametrize("block_rows", [9, 1024])
def test_bands_are_taken_one_after_the_other_and_leave_nothing(spark, monkeypatch, block_rows):
    """The same pairs, each once, and no blocks of vectors are left in the shared folder."""
    rows = near_rows(10)
    once = lsh.near_duplicates_approximate(frame(spark, rows), 0.93, 300, 0.9, 8, block_rows).collect()
    monkeypatch.setattr(lsh, "ROUND_BYTES", 1, raising=False)
    made = []
    stored = blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda *a: made.append(stored(*a)) or made[-1])
    found = lsh.near_duplicates_approximate(frame(spark, rows), 0.93, 300, 0.9, 8, block_rows).collect()
    assert [(r.row_a, r.row_b) for r in found] == [(r.row_a, r.row_b) for r in once] and len(set(found)) == len(found) > 100
    assert len(made) == lsh.bands_for(0.93, 0.9, 8)
    assert not any(os.path.exists(f.removeprefix("file:")) for table in made for f in table.inputFiles())
