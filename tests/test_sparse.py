"""The inverted index against brute force."""

import os

import numpy as np
import pytest
from test_similarity import cosines, expected_pairs, frame

from textcurate.operators import sparse
from textcurate.operators.embed import HashedEmbedder


def sparse_rows(seed, n=150, dim=40, signed=False):
    """Few used dimensions of skewed frequency; copies, near copies, zero rows and one dimension that all use."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(1, dim + 1)
    rows = (rng.random((n, dim)) < share) * rng.integers(1, 6, (n, dim)).astype(float)
    if signed:
        rows *= rng.choice([-1, 1], rows.shape)
    rows[:50] = rows[0]
    rows[50:90] = rows[50] + (rng.random((40, dim)) < 0.03)
    rows[-4:] = 0
    return rows[rng.permutation(n)].astype(np.float32)


@pytest.mark.parametrize("block_rows", [7, 1000])
@pytest.mark.parametrize("threshold,k,signed", [(0.95, 40, False), (0.6, 5000, False), (0.3, 700, True), (1.0, 30, False)])
def test_index_equals_brute_force(spark, block_rows, threshold, k, signed):
    rows = sparse_rows(1, signed=signed)
    found = sparse.near_duplicates_indexed(frame(spark, rows), threshold, k, block_rows).collect()
    pairs, scores = expected_pairs(rows, threshold, k)
    assert pairs and [(r.row_a, r.row_b) for r in found] == pairs
    assert np.allclose([r.similarity for r in found], scores, atol=1e-8)


def test_dense_vectors_and_tiny_tables(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(60, 5)).astype(np.float32)
    found = sparse.near_duplicates_indexed(frame(spark, rows), 0.9, 1000, 8).collect()
    assert [(r.row_a, r.row_b) for r in found] == expected_pairs(rows, 0.9, 1000)[0]
    for n in (0, 1):
        assert sparse.near_duplicates_indexed(frame(spark, rows[:n]), 0.9).collect() == []
    assert sparse.near_duplicates_indexed(frame(spark, np.zeros((3, 4), np.float32)), 0.9).collect() == []
    assert sparse.near_duplicates_indexed(frame(spark, rows), 0.9, 0).collect() == []
    for threshold in (0.0, -0.5, 1.5, float("nan")):
        with pytest.raises(ValueError):
            sparse.near_duplicates_indexed(frame(spark, rows), threshold)


def test_few_candidates_and_none_lost(spark):
    """Hashed documents: the index verifies a small part of all pairs, each once, and every near pair is among them."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables are not there")
    texts = sorted({r[0] for r in spark.read.parquet(path).select("text").collect()})
    rows = np.unique(np.asarray(HashedEmbedder(256)(texts), np.float32), axis=0)
    rows = rows[(rows != 0).any(axis=1)]
    found = [(r.a, r.b) for r in sparse.candidate_pairs(frame(spark, rows), 0.95, 64).collect()]
    near = set(zip(*(x.tolist() for x in np.nonzero(np.triu(cosines(rows) >= 0.95, 1)))))
    every = len(rows) * (len(rows) - 1) // 2
    assert len(set(found)) == len(found) and near <= set(found)
    assert len(found) < every / 10


def test_a_vector_is_stored_once_and_not_once_for_a_posting(spark):
    rows = np.unique(sparse_rows(3), axis=0)
    rows = rows[(rows != 0).any(axis=1)]
    packed = sparse._index(frame(spark, rows), 0.5, 1, 16).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in packed])
    assert sorted(ids.tolist()) == list(range(len(rows))) and len(packed) > 1


def test_blocks_too_far_apart_do_not_meet(spark, monkeypatch, tmp_path):
    """Beyond a few blocks, vectors are shipped to those alone that they may be near."""
    rng = np.random.default_rng(9)
    rows = np.zeros((240, 30))
    for k in range(6):
        rows[40 * k : 40 * k + 40, 5 * k : 5 * k + 5] = 1 + 0.2 * rng.random((40, 5))
    kernel = sparse._kernel
    path = str(tmp_path)

    def noted(threshold, k):
        inner = kernel(threshold, k)

        def verify(block, partners):
            partners = list(partners)
            for other in partners:
                if other is not block:
                    with open(os.path.join(path, f"{block.ids[0]}-{other.ids[0]}"), "w"):
                        pass
            return inner(block, partners)

        return verify

    monkeypatch.setattr(sparse, "_kernel", noted)
    found = sparse.near_duplicates_indexed(frame(spark, rows.astype(np.float32)), 0.97, 3000, 10).collect()
    assert [(r.row_a, r.row_b) for r in found] == expected_pairs(rows.astype(np.float32), 0.97, 3000)[0]
    met = [tuple(int(x) for x in name.split("-")) for name in os.listdir(path)]
    assert met and all(a // 40 == b // 40 for a, b in met)
