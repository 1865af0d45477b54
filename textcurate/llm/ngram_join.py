"""Similarity join of documents on the Jaccard similarity of their word n-gram sets.

MinHash signatures are cut into bands; documents that share a band's hash may be similar. Such buckets are kept as stars
around their first member, never as pairs, and their connected components bound what must be compared. In a component
all pairs are verified on the full n-gram sets, block against block, inside tasks that return counts and a
spanning forest of the links and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcurate.llm.components import components
from textcurate.llm.support import forget, text_or_empty
from textcurate.llm.words import grouped, mix, shingles, word_hashes
from textcurate.plans.scratch import materialize

# Documents of a component, and n-grams of theirs, that meet in one task: one block against itself or another.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
_SIGNED = "row long, id long, k1 long, k2 long, n int, bands array<long>"
_VERIFIED = "node long, links long, head long"


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands needed so that a pair at the threshold shares one with at least probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shifts = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.weights = random.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, grams: np.ndarray) -> np.ndarray:
        """Least value of each hash function over a set of 64-bit hashes."""
        low = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            x = short[at : at + 256, None] ^ self.shifts
            x *= self.factors
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x846CA68B)
            np.minimum(low, x.min(axis=0), out=low)
        return low

    def band_keys(self, grams: np.ndarray) -> np.ndarray:
        table = self.signature(grams).reshape(self.bands, self.rows).astype(np.uint64)
        mixed = (mix(table + np.uint64(1)) * self.weights).sum(axis=1, dtype=np.uint64)
        return mix(mixed + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """A written table of the columns and ``row``, a number of each row's own. Read again, a row has the same number."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "ngram-rows")


def _lowered(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return rows.select(
        "row", F.col(id_column).cast("long").alias("id"), F.lower(text_or_empty(text_column)).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(row, id, k1, k2, n, bands)`` from ``(row, id, text)``: two hashes that name the n-gram set, its size, and its band hashes."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        minhash = MinHash(bands, rows)
        for batch in slices(batches):
            for first, group in grouped(batch.column(2).to_pylist()):
                sets = shingles(*word_hashes(group), n)
                keys = [minhash.band_keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
                names = np.array([[s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)] for s in sets]).view(np.int64)
                ends = np.cumsum([0, *map(len, keys)])
                columns = [
                    batch.column(0).slice(first, len(group)),
                    batch.column(1).slice(first, len(group)),
                    pa.array(names[:, 0]),
                    pa.array(names[:, 1]),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "k1", "k2", "n", "bands"])

    return docs.mapInArrow(signed, _SIGNED)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Hashes in one set only are left out first."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, int)
    sizes = np.diff(np.append(heads, len(grams)))
    shared = np.zeros((n, n), np.float32)
    column = np.repeat(np.arange(len(heads)), sizes)
    kept = np.repeat(sizes > 1, sizes)
    owner, column = owner[kept], column[kept]
    width = max(256, (1 << 22) // max(1, n))
    at = 0
    while at < len(column):
        stop = np.searchsorted(column, column[at] + width)
        # Columns are renumbered, so that a slice is as dense as can be.
        _, place = np.unique(column[at:stop], return_inverse=True)
        dense = np.zeros((n, int(place[-1]) + 1), np.float32)
        dense[owner[at:stop], place] = 1.0
        shared += dense @ dense.T
        at = stop
    return shared


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches ``threshold``; none with itself or an empty set."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (shared >= threshold * union - 1e-9) & (shared > 0)
    np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each place the smallest node that links lead to."""
    heads = nodes.copy()
    while True:
        reached = np.where(linked, heads[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        reached = np.minimum(heads, reached)
        if (reached == heads).all():
            return heads
        heads = reached


def _verify(units: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per unit ``(component, i, j)``: links of its documents, within block ``i`` if ``i = j``, else between the two."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        own = sorted(rows, key=lambda row: row[4])
        nodes = np.array([row[4] for row in own], np.int64)
        sets = []
        for _, group in grouped([row[6] for row in own]):
            sets += shingles(*word_hashes(group), n)
        linked = links(sets, threshold)
        if rows[0][1] != rows[0][2]:
            block = np.array([row[3] for row in own])
            linked &= block[:, None] != block[None, :]
        copies = np.array([row[5] for row in own], np.int64)
        counts = linked.astype(np.int64) @ copies
        columns = [pa.array(nodes), pa.array(counts), pa.array(_forest(linked, nodes))]
        return pa.RecordBatch.from_arrays(columns, ["node", "links", "head"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows, key = [], None
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key and rows:
                    yield work(rows)
                    rows = []
                key = row[:3]
                rows.append(row)
        if rows:
            yield work(rows)

    placed = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return placed.select("component", "i", "j", "block", "node", "copies", "text").mapInArrow(verified, _VERIFIED)


def classify(
    rows: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.999,
    band_rows: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(signed, classes, heads)`` of a table made by :func:`numbered`. Row numbers alone tell rows apart.

    ``signed (row, id, k1, k2, n)`` has every row, ``classes (k1, k2, first, component, n_links)`` every n-gram set that is
    not empty and ``heads (component, head)`` every group of linked sets. ``first`` and ``head`` are the struct
    ``(no_id, id, row)`` of the row with the smallest id, null ids last, then the smallest number.
    """
    bands = bands_for(threshold, recall, band_rows)
    lowered = _lowered(rows, id_column, text_column)
    signed = materialize(sign(lowered, n, bands, band_rows), "ngram-signatures")
    # Copies of an n-gram set are one node of the graph from here on, named by the number of their first row.
    classes = signed.filter("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"),
        F.count("*").alias("copies"),
        F.max("n").alias("grams"),
        F.min_by("bands", "row").alias("bands"),
    )
    classes = materialize(classes.withColumn("node", F.col("first.row")), "ngram-classes")
    band = classes.select("node", F.explode("bands").alias("key"))
    stars = band.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last")
    stars = band.join(stars.select("key", "head"), "key").filter("node <> head")
    near = components(stars.select(F.col("node").alias("u"), F.col("head").alias("v")))
    near = near.join(classes.select("node", "copies", "grams"), "node")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("grams") / BLOCK_GRAMS))
    sizes = near.groupBy("component").agg(blocks.cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = near.join(sizes, "component").withColumn("block", block)
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    )
    texts = lowered.select(F.col("row").alias("node"), "text").join(near.select("node"), "node", "left_semi")
    units = units.drop("blocks", "other", "grams").join(texts, "node")
    verified = materialize(_verify(units, n, threshold), "ngram-links")
    counts = verified.groupBy("node").agg(F.sum("links").alias("links"))
    forest = components(verified.filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
    found = classes.join(counts.join(forest, "node", "left"), "node", "left").select(
        "k1",
        "k2",
        "first",
        F.coalesce("component", "node").alias("component"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    found = materialize(found, "ngram-components")
    return signed.drop("bands"), found, found.groupBy("component").agg(F.min("first").alias("head"))


def ngram_join(
    docs: DataFrame,
    threshold: float = 0.8,
    n: int = 5,
    recall: float = 0.999,
    rows: int = 8,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, class_id, n_links, rep_id, n_grams)`` for every row.

    Two documents are linked if the Jaccard similarity of their sets of ``n`` successive words is ``threshold`` or
    more. ``n_links`` counts the documents linked to this one, copies included; ``class_id`` is the smallest id that
    links lead to, ``rep_id`` the smallest id with the same n-gram set. Bands of ``rows`` are as many as let a pair at
    the threshold be found with probability ``recall``; everything found is exact. A text of 1 to n-1 words is one
    n-gram; a null text or one without words has none, links to nothing and is its own class. Ids are integers. Every row
    is a document of its own, whether its id is null or that of other rows, with the same text or another; where all ids
    are null, so are ``class_id`` and ``rep_id``. Other columns are not read.
    """
    table = numbered(docs, F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed, classes, heads = classify(table, threshold, n, recall, rows, "id", "text")
    named = classes.join(heads, "component").drop("component")
    out = signed.join(named, ["k1", "k2"], "left")
    has_grams = F.col("n") > 0
    return out.select(
        F.col("id").alias(id_column),
        F.when(has_grams, F.col("head.id")).otherwise(F.col("id")).alias("class_id"),
        F.when(has_grams, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
        F.when(has_grams, F.col("first.id")).otherwise(F.col("id")).alias("rep_id"),
        F.col("n").alias("n_grams"),
    )


def first_rows(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``(row)``: of a table made by :func:`numbered`, one row of each group that links lead through, and all rows
    without n-grams. The smallest id stays, null ids last, then the smallest number."""
    signed, _, heads = classify(rows, id_column=id_column, text_column=text_column, **options)
    return heads.select("head.row").unionByName(signed.filter("n = 0").select("row"))
