"""The embedding cache: an append-only table that maps a content hash to a vector.

A cache is a folder with three folders in it. ``data/<commit>`` holds the Parquet files of one commit, each of which covers a
run of hash prefixes of the keys. ``index/<commit>.<entries>`` describes these files, each with its run and a Bloom
filter of its keys, and is the ledger as well: it appears by one rename once data and description are complete, and what
has no entry there does not exist for readers. So a commit is seen whole or not at all, and a commit that is tried again
under its name replaces what was left half-written, or is skipped if it is done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from textcurate.functions.text import cache_key, quoted
from textcurate.plans.scratch import names_in, no_rows, rename, shuffles_dropped
from textcurate.plans.skew import join_on_unique
from textcurate.schema import KEY, VECTOR

SCHEMA = "key string, dim int, vector array<float>, status string, written_at timestamp, model string"
DEFAULT_DIM = 1024
# Up to this many keys of 64 characters are broadcast, and their hashes (16 bytes each) looked up in the index.
FEW_KEYS = 200_000
# A cache of up to this many entries is probed without its index: reading its keys takes no longer.
FEW_ENTRIES = 200_000
# Up to this many files are read by name; beyond, all are.
FEW_FILES = 10_000
# Hash prefixes, a power of two; a commit has no more files than these.
PREFIXES = 1024
# Entries per file that a compaction aims at.
FILE_ENTRIES = 100_000
# Keys that a task remembers while it drops copies: some 15 MB.
SEEN_KEYS = 100_000
BLOOM_BITS, BLOOM_PROBES = 16, 6
_INDEX = "file string, model string, low int, high int, n bigint, least_dim int, most_dim int, bloom binary"


def prefix(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - (PREFIXES - 1).bit_length()).cast("int")


def by_prefix(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows in ``parts`` partitions, each of a run of prefixes, by key within. Nothing is evaluated to find the runs."""
    parts = max(1, min(parts, PREFIXES))
    run = F.floor(prefix(F.col(key)) * F.lit(parts) / PREFIXES).cast("int")
    return df.repartitionById(parts, run).sortWithinPartitions(key)


def once_by_prefix(texts: DataFrame, parts: int) -> DataFrame:
    """One row ``(_key, text)`` per key, in partitions as :func:`by_prefix` makes them; texts are exchanged once, by run.

    A task drops the copies that it sees itself, so that a text with many copies is a few rows of its partition.
    """

    def drop_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            kept = []
            for k, key in enumerate(batch.column(0).to_pylist()):
                if key not in seen:
                    seen.add(key)
                    kept.append(k)
            if kept:
                yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept))
            # A key that comes again after this costs a copy in the exchange and no results.
            if len(seen) > SEEN_KEYS:
                seen.clear()

    parts = max(1, min(parts, PREFIXES))
    run = F.floor(prefix(F.col(KEY)) * F.lit(parts) / PREFIXES).cast("int")
    rows = texts.select(KEY, "text").mapInArrow(drop_seen, texts.select(KEY, "text").schema)
    placed = rows.withColumn("_run", run).repartitionById(parts, F.col("_run"))
    # Grouped by run as well, the exchange by run is the one that grouping needs.
    return placed.groupBy("_run", KEY).agg(F.first("text").alias("text")).select(KEY, "text").sortWithinPartitions(KEY)


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("bloom"), F.col(key)).alias("h2")]


def _bits(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Which bits of a filter of ``size`` (a power of two) stand for keys: one row per key."""
    one, two = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    probes = np.arange(BLOOM_PROBES, dtype=np.uint64)
    return ((one[:, None] + probes * two[:, None]) >> np.uint64(20)) & np.uint64(size - 1)


def _bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    size = max(1024, 1 << (BLOOM_BITS * len(h1) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_bits(h1, h2, size).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _may_hold(bloom: bytes, h1: np.ndarray, h2: np.ndarray) -> bool:
    filled = np.frombuffer(bloom, np.uint8)
    at = _bits(h1, h2, 8 * len(filled))
    return bool(((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1).any())


def with_key(df: DataFrame, text_column: str, model: str) -> DataFrame:
    return df.withColumn(KEY, cache_key(model, quoted(text_column)))


def _newest(entries: DataFrame, *by: str) -> DataFrame:
    # Entries of the same moment are told apart by their content, so that every reader sees the same one.
    order = [F.col("written_at").desc(), F.col("status").desc(), F.xxhash64("vector")]
    newest = Window.partitionBy(*by).orderBy(*order)
    return entries.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class EmbeddingCache:
    """``status`` is ``ok``, or ``nan`` with a null vector."""

    spark: SparkSession
    path: str

    # ---- commits

    def commits(self) -> dict[str, int]:
        """Names of complete commits, and how many entries each has."""
        found = (name.rpartition(".") for name in names_in(self.spark, f"{self.path}/index"))
        return {name: int(n) for name, _, n in found}

    def append(self, entries: DataFrame, commit: str | None = None) -> None:
        """Add entries in one commit; an entry for a known key replaces the older one on reading.

        A named commit happens once: if it is complete, nothing is written, and ``entries`` are not evaluated.
        """
        if commit is None:
            commit = uuid.uuid4().hex
        elif commit in self.commits():
            return
        columns = ("key", "dim", "vector", "status", "written_at", "model")
        with shuffles_dropped(entries.sparkSession):
            entries.select(*columns).write.mode("overwrite").parquet(f"{self.path}/data/{commit}")
        counted = Observation()
        # A small row per file of the commit: in one file, so that an index of many commits is few files to list and open.
        described = self._describe(commit).repartition(1).observe(counted, F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        described.write.mode("overwrite").parquet(f"{self.path}/pending/{commit}")
        self._publish(commit, counted.get["n"])

    def seal(self, commit: str) -> None:
        """Note that something with this name is done."""
        if commit not in self.commits():
            none = no_rows(self.spark, _INDEX)
            none.write.mode("overwrite").parquet(f"{self.path}/pending/{commit}")
            self._publish(commit, 0)

    def _publish(self, commit: str, entries: int) -> None:
        rename(self.spark, f"{self.path}/pending/{commit}", f"{self.path}/index/{commit}.{entries}")

    def _describe(self, commit: str) -> DataFrame:
        """A row per file and model, or several where tasks share a file."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict = {}
            for batch in batches:
                files = batch.column("file").dictionary_encode()
                models = batch.column("model").dictionary_encode()
                numbers = [np.asarray(batch.column(c)) for c in ("prefix", "h1", "h2")]
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for f, file in enumerate(files.dictionary.to_pylist()):
                    for m, model in enumerate(models.dictionary.to_pylist()):
                        here = (np.asarray(files.indices) == f) & (np.asarray(models.indices) == m)
                        if here.any():
                            found.setdefault((file, model), []).append([x[here] for x in (*numbers, dims)])
            for (file, model), parts in found.items():
                at, h1, h2, dims = (np.concatenate(x) for x in zip(*parts))
                dims = dims[~np.isnan(dims.astype(float))]
                row = {
                    "file": file,
                    "model": model,
                    "low": int(at.min()),
                    "high": int(at.max()),
                    "n": len(at),
                    "least_dim": int(dims.min()) if len(dims) else None,
                    "most_dim": int(dims.max()) if len(dims) else None,
                    "bloom": _bloom(h1, h2),
                }
                yield pa.RecordBatch.from_pylist([row], schema)

        numbers = [(c, pa.int32()) for c in ("low", "high")], [(c, pa.int32()) for c in ("least_dim", "most_dim")]
        schema = pa.schema(
            [("file", pa.string()), ("model", pa.string()), *numbers[0], ("n", pa.int64()), *numbers[1], ("bloom", pa.binary())]
        )
        written = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{commit}")
        name = F.regexp_extract(F.col("_metadata.file_path"), ".*/data/(.+)$", 1).alias("file")
        return written.select(name, "model", prefix(F.col("key")).alias("prefix"), *_hashes("key"), "dim").mapInArrow(run, _INDEX)

    # ---- reading

    def _index(self) -> DataFrame:
        paths = [f"{self.path}/index/{name}.{n}" for name, n in self.commits().items() if n]
        return self.spark.read.schema(_INDEX).parquet(*paths) if paths else no_rows(self.spark, _INDEX)

    def read(self) -> DataFrame:
        paths = [f"{self.path}/data/{name}" for name, n in self.commits().items() if n]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else no_rows(self.spark, SCHEMA)

    def files_for(self, model: str, few: DataFrame) -> list[str] | None:
        """The files that may hold any of the ``_key`` values of a table of at most ``FEW_KEYS`` rows: those whose run of
        prefixes and whose filter say so. ``None`` stands for all files, where looking is not worth it or too many are left.
        """
        if sum(self.commits().values()) <= FEW_ENTRIES:
            return None
        hashes = few.select(prefix(F.col(KEY)).alias("prefix"), *_hashes(KEY)).distinct().toArrow()
        wanted = self.spark.sparkContext.broadcast([np.asarray(hashes.column(c).combine_chunks()) for c in ("prefix", "h1", "h2")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, h1, h2 = wanted.value
            for batch in batches:
                kept = []
                for row in batch.to_pylist():
                    here = (at >= row["low"]) & (at <= row["high"])
                    if here.any() and _may_hold(row["bloom"], h1[here], h2[here]):
                        kept.append(row["file"])
                yield pa.RecordBatch.from_pydict({"file": pa.array(kept, pa.string())})

        described = self._index().filter(F.col("model") == model).select("file", "low", "high", "bloom")
        found = described.mapInArrow(run, "file string").distinct().limit(FEW_FILES + 1).collect()
        return [f"{self.path}/data/{r[0]}" for r in found] if len(found) <= FEW_FILES else None

    def _entries(self, model: str, few: DataFrame | None) -> DataFrame:
        files = None if few is None else self.files_for(model, few)
        if files is None:
            entries = self.read()
        elif files:
            entries = self.spark.read.schema(SCHEMA).parquet(*files)
        else:
            entries = no_rows(self.spark, SCHEMA)
        return entries.filter(F.col("model") == model)

    def for_model(self, model: str, few: DataFrame | None = None) -> DataFrame:
        """One row per key, the newest; ``few`` limits this to the ``_key`` values of a table that may be broadcast.

        The join that follows needs the same exchange by key, so this adds none.
        """
        entries = self._entries(model, few)
        if few is not None:
            entries = entries.join(F.broadcast(few.withColumnRenamed(KEY, "key")), "key", "left_semi")
        # All entries are of one model; named as well, it would keep the join from using this exchange.
        return _newest(entries, "key")

    def keys(self, model: str, few: DataFrame | None = None) -> DataFrame:
        """The model's keys under the name used by datasets; reads no vectors, and with ``few`` only the files that may
        hold one of its ``_key`` values."""
        return self._entries(model, few).select(F.col("key").alias(KEY)).distinct()

    def compact(self, path: str) -> EmbeddingCache:
        """Write the newest entry of every key to the unused ``path`` in one commit, and return the cache there.

        The files here are many, one per task and commit; there they are few, and each covers a run of prefixes. This
        folder stays as it is, for those who read it.
        """
        if names_in(self.spark, f"{path}/index"):
            raise FileExistsError(f"there is a cache in {path}")
        small = EmbeddingCache(self.spark, path)
        files = -(-sum(self.commits().values()) // FILE_ENTRIES)
        small.append(by_prefix(_newest(self.read(), "model", "key"), "key", files), "compacted")
        return small

    def dim(self, model: str) -> int | None:
        """The one vector length of this model, ``None`` while no vector is known; reads the index only."""
        sizes = self._index().filter(F.col("model") == model).agg(F.min("least_dim"), F.max("most_dim")).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"cache of {model!r} holds vectors of {sizes[0]} to {sizes[1]} dimensions")
        return sizes[1]

    def stats(self) -> DataFrame:
        """Number of keys per model and dimension."""
        entries = self.read().select("model", "dim", "key").distinct()
        return entries.groupBy("model", "dim").agg(F.count("*").alias("rows"))


def probe(rows: DataFrame, cache_keys: DataFrame) -> DataFrame:
    """One row ``(_key, copies, _hit)`` per distinct text: how many rows have it, and is it in the cache?"""
    # Keys are counted before they meet the cache, so a text that fills a third of the rows is one row here.
    return mark_known(rows.groupBy(KEY).agg(F.count("*").alias("copies")), cache_keys)


def mark_known(distinct: DataFrame, cache_keys: DataFrame) -> DataFrame:
    """Add ``_hit`` to a table of different keys."""
    marked = distinct.join(cache_keys.withColumn("_hit", F.lit(True)), KEY, "left")
    return marked.withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def misses(rows: DataFrame, text_column: str, missing_keys: DataFrame, few: bool = False) -> DataFrame:
    """One row ``(_key, text)`` per text whose key is missing; ``few`` says that the keys may be broadcast."""
    text = F.first(quoted(text_column)).alias("text")
    if few:
        # Only the texts wanted are exchanged.
        return rows.join(F.broadcast(missing_keys), KEY, "left_semi").groupBy(KEY).agg(text)
    # Copies are combined map-side before the join. Catalyst would push a semi join below the aggregate, where a text
    # with many copies is a hot key; it leaves an inner join, which is the same for unique keys, where it is.
    return rows.groupBy(KEY).agg(text).join(missing_keys, KEY)


def attach_vectors(
    rows: DataFrame, cache: EmbeddingCache, model: str, size: int | None = None
) -> tuple[DataFrame, int]:
    """Rows with ``_embedding``, and the vector length (0 if there is nothing to attach); ``size`` rows, if that is known.

    Where the model answered NaN the vector is all zeros, as long as the model's other vectors.
    """
    dim = cache.dim(model)
    size = rows.count() if size is None else size
    # A small dataset takes its few entries out of a large cache before they are exchanged.
    few = rows.select(KEY).distinct() if size <= FEW_KEYS else None
    entries = cache.for_model(model, few)
    fill = F.array_repeat(F.lit(0.0).cast("float"), dim or DEFAULT_DIM)
    vectors = entries.select(F.col("key").alias(KEY), F.coalesce("vector", fill).alias(VECTOR))
    if dim is None:
        dim = 0 if entries.isEmpty() else DEFAULT_DIM
    return join_on_unique(rows, vectors, KEY, "left", total=size), dim
