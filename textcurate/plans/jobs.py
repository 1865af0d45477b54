"""Batch jobs: fill the cache ahead of time, and the two halves of curation by hand."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textcurate.functions.text import coerce_bool, quoted
from textcurate.operators.cache import EmbeddingCache, with_key
from textcurate.operators.embed import EmbedConfig, Embedder, fill_cache
from textcurate.operators.project import MIN_ROWS
from textcurate.plans.dataset import Dataset, default_cache_path, load
from textcurate.plans.scratch import discard, materialize
from textcurate.schema import SOURCE_POSITION
from textcurate.sources.readers import read_dataset, read_table
from textcurate.sources.writers import default_target, write_table


def pre_embed(
    spark: SparkSession,
    path: str,
    embedder: Embedder,
    config: EmbedConfig,
    text_column: str = "text",
    cache_path: str | None = None,
    on_progress: Callable[[int, int], None] | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """Embed a dataset into the cache, so that a later ``load`` finds every vector there."""
    started = time.monotonic()
    source = read_dataset(spark, path, text_column)
    cache = EmbeddingCache(spark, cache_path or default_cache_path(path))
    # Stored once: the source is read for its keys and again for the texts that are missing.
    counted = Observation()
    texts = source.rows.select(quoted(source.text_column).alias("text")).observe(counted, F.count(F.lit(1)).alias("rows"))
    rows = materialize(with_key(texts, "text", config.model), "texts")
    counts = fill_cache(rows, "text", cache, embedder, config, on_progress, sleep, size=counted.get["rows"])
    return {
        "rows": counts["rows"],
        "text_column": source.text_column,
        "embedding_dim": cache.dim(config.model) or 0,
        "fresh": counts["fresh_rows"],
        "hits": counts["hits"],
        "seconds": time.monotonic() - started,
    }


def prepare(spark: SparkSession, path: str, embedder: Embedder, config: EmbedConfig, **options) -> tuple[Dataset, str]:
    """First half: load, project, and write the template to be edited; ``scatter_frame`` shows what to edit."""
    dataset = load(spark, path, embedder, config, **options)
    if dataset.coordinates is None and dataset.size >= MIN_ROWS:
        dataset, _ = dataset.project_2d()
    return dataset, dataset.write_template()["path"]


def edited_kept(curated: DataFrame) -> DataFrame:
    """The rows an edited table keeps, without ``keep``. A blank cell keeps its row."""
    return curated.filter(_is_kept(curated)).drop("keep", *SOURCE_POSITION)


def _is_kept(curated: DataFrame) -> Column:
    return coerce_bool(F.col("keep"), curated.schema["keep"].dataType, if_null=True)


def finalize(spark: SparkSession, path: str, curated: str | None = None, target: str | None = None) -> dict:
    """Second half: read the edited template of ``path`` back and write the rows it keeps."""
    edited = read_table(spark, curated or default_target(path, "curated"))
    target = target or default_target(path, "kept")
    # The place within a split is counted while reading; file, split and place together are the order of the source.
    place = [c for c in SOURCE_POSITION if c in edited.columns] + ["__place"]
    # Stored once: sorting looks at the rows twice, and all of them are counted on the way.
    counted = Observation()
    ordered = edited.withColumn("__place", F.monotonically_increasing_id()).observe(counted, F.count(F.lit(1)).alias("rows"))
    ordered = materialize(ordered.filter(_is_kept(edited)), "edited")
    discard(edited, "cells")
    kept = ordered.repartitionByRange(*place).sortWithinPartitions(*place)
    rows = write_table(kept.drop("keep", *place), target)
    discard(ordered, "edited")
    return {"path": target, "rows": rows, "total": counted.get["rows"]}
