"""Embedding new files as they arrive."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.text import quoted
from textcurate.operators.cache import EmbeddingCache, with_key
from textcurate.operators.embed import EmbedConfig, Embedder, fill_cache
from textcurate.plans.scratch import materialize
from textcurate.schema import string_columns
from textcurate.sources.readers import CSV_RULES, drop_na_tokens


def embed_new_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    text_column: str,
    cache: EmbeddingCache,
    embedder: Embedder,
    config: EmbedConfig,
    checkpoint: str,
    file_format: str = "parquet",
    files_per_batch: int = 1000,
    options: dict | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Embed the texts of all files not seen by ``checkpoint`` yet, batch by batch; returns the number of batches.

    The cache keeps a ledger of the batches of each checkpoint. What a batch writes can be seen once it is complete; a
    batch that is run again after a failure writes over what was left half-written and embeds only what is still
    missing, and one that was finished before Spark noted it is passed over. A batch looks only into those files of the
    cache that may hold one of its texts. There is no watermark: what counts is a text's content, not its time.
    CSV is read under the rules of :func:`textcurate.sources.readers.read_csv`, whole files at a time, as a quoted
    cell may hold line breaks; broken JSON ends the query. ``options`` are those of Spark's reader and come last.
    """
    rules = {"csv": {**CSV_RULES, "multiLine": True}, "json": {"mode": "FAILFAST"}}.get(file_format, {})
    reader = spark.readStream.format(file_format).schema(schema).options(**{**rules, **(options or {})})
    cells = reader.option("maxFilesPerTrigger", files_per_batch).load(folder)
    if file_format == "csv":
        cells = drop_na_tokens(cells, string_columns(cells.schema))
    rows = (
        cells.filter(quoted(text_column).isNotNull())
        .select(quoted(text_column).cast("string").alias("text"))
    )

    batches = 0
    # The same for every run with this checkpoint, as batch numbers are.
    stream = "stream" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def embed_batch(batch: DataFrame, number: int) -> None:
        nonlocal batches
        batches += 1
        name = f"{stream}-{number}"
        if f"{name}-done" in cache.commits():
            return
        counted = Observation()
        keyed = with_key(batch, "text", config.model).observe(counted, F.count(F.lit(1)).alias("rows"))
        texts = materialize(keyed, "batch")
        fill_cache(texts, "text", cache, embedder, config, sleep=sleep, commit=name, size=counted.get["rows"])
        cache.seal(f"{name}-done")

    query = (
        rows.writeStream.foreachBatch(embed_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return batches
