"""Batch embedding of texts through a caller's model, and the offline stand-in model."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textcurate.functions.text import normalize_string, quoted
from textcurate.operators.cache import FEW_KEYS, EmbeddingCache, by_prefix, mark_known, misses, once_by_prefix
from textcurate.plans.scratch import materialize
from textcurate.schema import KEY

# An embedder takes normalised texts and returns one reply per text: a vector, or a mapping with ``index`` and
# ``embedding`` when the service may answer out of order. It is pickled to the executors.
Embedder = Callable[[list[str]], Sequence]
# Tokens of up to so many characters, and so many of them, are remembered per Python worker: some 5 MB.
LONG_TOKEN, MAX_TOKENS = 64, 40_000
_TOKENS = re.compile(r"[^\W_]+")


class NaNEmbeddingError(RuntimeError):
    """The model produced NaN for this input; trying again will not help."""


class ServiceError(RuntimeError):
    """The embedding service answered with an HTTP error status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status

    def __reduce__(self):
        return ServiceError, (self.status, str(self).partition(" ")[2])


@dataclass(frozen=True)
class EmbedConfig:
    """``batch_size`` 1 asks for one text per request. ``concurrency`` bounds the tasks that call the model at once."""

    model: str
    batch_size: int = 64
    # Seconds to wait before the second, third and fourth try.
    retry_delays: tuple[float, ...] = (5.0, 20.0, 60.0)
    # Progress is committed to the cache after about this many texts.
    commit_rows: int = 1_000_000
    concurrency: int | None = None




def _worth_retrying(error: Exception) -> bool:
    if isinstance(error, ServiceError):
        return error.status >= 500
    return isinstance(error, (TimeoutError, ConnectionError))


def request(
    embedder: Embedder, texts: list[str], delays: Sequence[float], sleep: Callable[[float], None] = time.sleep
) -> list:
    """One request with retries; the replies come back in the order of the texts."""
    for attempt in range(len(delays) + 1):
        try:
            replies = list(embedder(texts))
            break
        except Exception as error:
            if not _worth_retrying(error):
                raise
            if attempt == len(delays):
                raise RuntimeError(f"embedding failed after {len(delays) + 1} attempts") from error
            sleep(delays[attempt])
    if replies and isinstance(replies[0], Mapping):
        replies = [r["embedding"] for r in sorted(replies, key=lambda r: r["index"])]
    if len(replies) != len(texts):
        raise RuntimeError(f"the model returned {len(replies)} vectors for {len(texts)} texts")
    return replies


def embed_texts(
    texts: DataFrame, embedder: Embedder, config: EmbedConfig, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Cache entries for rows ``(_key, text)``. Must be stored before use: each evaluation calls the model."""

    def vectors_of(chunk: list[str]) -> list:
        try:
            return request(embedder, chunk, config.retry_delays, sleep)
        except NaNEmbeddingError:
            if len(chunk) == 1:
                return [None]
            return [v for text in chunk for v in vectors_of([text])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, config.batch_size):
                part = batch.slice(start, config.batch_size)
                chunk = [normalize_string(t) for t in part.column("text").to_pylist()]
                vectors = [None if v is None else np.asarray(v, dtype=np.float32) for v in vectors_of(chunk)]
                # A component that is no number would spoil every comparison: such a reply counts as none.
                vectors = [v if v is not None and np.isfinite(v).all() else None for v in vectors]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": part.column(KEY).cast(pa.string()),
                        "dim": pa.array([None if v is None else len(v) for v in vectors], pa.int32()),
                        "vector": pa.array(vectors, pa.list_(pa.float32())),
                        "status": pa.array(["nan" if v is None else "ok" for v in vectors], pa.string()),
                    }
                )

    entries = texts.select(KEY, "text").mapInArrow(run, "key string, dim int, vector array<float>, status string")
    return entries.withColumns({"written_at": F.current_timestamp(), "model": F.lit(config.model)})


def fill_cache(
    rows: DataFrame,
    text_column: str,
    cache: EmbeddingCache,
    embedder: Embedder,
    config: EmbedConfig,
    on_progress: Callable[[int, int], None] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    commit: str | None = None,
    size: int | None = None,
) -> dict:
    """Embed every text of ``rows`` (which carry ``_key``) that the cache lacks, each text once.

    Texts are embedded and committed slice by slice, so an interrupted job loses one slice at most and a second run
    starts from what is in the cache. ``on_progress`` is told after each how many of the rows have a vector. Commits are
    named after ``commit`` and numbered, if it is given, so that what a failed run left half-written is overwritten. ``size`` is the number of rows, or a bound on it, if that is known.
    """
    spark = rows.sparkSession
    counted = Observation()
    if size is None:
        distinct = materialize(rows.groupBy(KEY).agg(F.count("*").alias("copies")), "distinct-keys")
        size = distinct.count()
    else:
        distinct = rows.groupBy(KEY).agg(F.count("*").alias("copies"))
    few = distinct.select(KEY) if size <= FEW_KEYS else None
    marked = mark_known(distinct, cache.keys(config.model, few)).observe(
        counted,
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_hit"), F.col("copies"))), F.lit(0)).alias("hits"),
        F.count_if(~F.col("_hit")).alias("fresh_keys"),
    )
    keys = materialize(marked, "keys")
    count = counted.get
    fresh, done = count["fresh_keys"], count["hits"]
    if on_progress and done:
        on_progress(done, count["rows"])
    if fresh:
        slices = math.ceil(fresh / config.commit_rows)
        in_slice = F.pmod(F.xxhash64(F.lit("slice"), KEY), F.lit(slices)).alias("slice")
        missing = keys.filter(~F.col("_hit"))
        few, moved = fresh <= FEW_KEYS, False
        if few or not count["hits"]:
            # Copies are dropped by the exchange that the model needs anyway.
            pending = rows.join(F.broadcast(missing.select(KEY)), KEY, "left_semi") if few else rows.filter(F.col(KEY).isNotNull())
            pending = pending.select(KEY, quoted(text_column).alias("text"), in_slice)
        else:
            pending, moved = misses(rows, text_column, missing.select(KEY)).select("*", in_slice), True
        # A single slice is read once, so it need not be stored.
        if slices > 1:
            pending = materialize(pending, "pending", partition_by="slice")
        # A model call costs far more than its few bytes, so tasks are cut by rows and not left to size-based merging.
        busy = min(spark.sparkContext.defaultParallelism, math.ceil(fresh / config.batch_size))
        tasks = config.concurrency or max(busy, math.ceil(fresh / slices / 4096))
        names = [None] * slices
        if commit:
            done_before = sum(name.startswith(f"{commit}-") for name in cache.commits())
            names = [f"{commit}-{done_before + number}" for number in range(slices)]
        for number in range(slices):
            # Each task embeds a run of key prefixes, and its file covers that run.
            part = pending.filter(F.col("slice") == number) if slices > 1 else pending
            part = by_prefix(part, KEY, tasks) if moved else once_by_prefix(part, tasks)
            cache.append(embed_texts(part, embedder, config, sleep), names[number])
            if on_progress:
                embedded = missing.select(in_slice, "copies").filter(F.col("slice") == number)
                done += embedded.agg(F.sum("copies")).first()[0] or 0
                on_progress(done, count["rows"])
    return {
        "rows": count["rows"],
        "hits": count["hits"],
        "fresh_rows": count["rows"] - count["hits"],
        "fresh_keys": fresh,
    }


class _Buckets(dict):
    """Token to bucket, found once for each token; a full table is emptied, which costs time and no results."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        bucket = int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big") % self.dim
        if len(token) <= LONG_TOKEN:
            if len(self) >= MAX_TOKENS:
                self.clear()
            self[token] = bucket
        return bucket


# One table per Python worker and length of vectors.
_buckets = lru_cache(maxsize=4)(_Buckets)


@dataclass(frozen=True)
class HashedEmbedder:
    """Offline stand-in for a model: a bag of words hashed into ``dim`` buckets, scaled to unit length."""

    dim: int = 256

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._vector(text) for text in texts]

    def _vector(self, text: str) -> np.ndarray:
        # Letters and digits of any script make up a token.
        found = list(map(_buckets(self.dim).__getitem__, _TOKENS.findall(text.lower())))
        weights = np.bincount(found, minlength=self.dim).astype(np.float64) if found else np.zeros(self.dim)
        return (weights / (np.sqrt(np.sum(weights * weights)) + 1e-12)).astype(np.float32)
