"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.llm import pretokens
from textcurate.llm.support import file_bytes, once, text_or_empty


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row, for a byte-level BPE tokenizer in a ``tokenizers`` JSON file.

    Which vocabulary strings encode alone as one token is proved once, on the driver; pre-tokens among them are counted
    as they are and only the others are merged. Counts equal the library's without added special tokens; strings of
    special tokens inside a text count as the library takes them. A null text counts as an empty one (0 bytes,
    0 tokens); repeated rows and ids each get their row; other columns are not looked at, so they may have any name.
    Rows stay where they are: nothing is exchanged.
    """
    spark = docs.sparkSession
    content = file_bytes(spark, tokenizer_path)
    whole = spark.sparkContext.broadcast(pretokens.whole_tokens(pretokens.load(content.value)))
    key = ("chunk-coder", tokenizer_path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = once(key, lambda: pretokens.ChunkCoder(content.value, whole.value))
        for texts in batches:
            yield pd.Series([coder.count(t) for t in texts], dtype="int64")

    text = text_or_empty(text_column)
    counted = docs.select(
        F.col(id_column), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
