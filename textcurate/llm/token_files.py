"""Token ids as Huffman-coded files, in the order of the documents.

A folder holds three Parquet tables. ``codebook`` (symbol, bits): code lengths of the canonical code. ``blocks``: one row
per block of whole documents, decodable by itself: shard, first_token (ids of the shard before it), doc_ids,
doc_tokens, payload (codes, most significant bit first, each document from a full byte on) and marks (bit offset of
every 256th id of each document, unsigned 64-bit little-endian). ``shards`` (shard, n_tokens, start).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textcurate.llm import pretokens
from textcurate.llm.huffman import Decoder, Encoder, code_lengths
from textcurate.llm.support import file_bytes, once, text_or_empty
from textcurate.plans.scratch import scratch_path

_BLOCKS = "shard int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary, marks binary"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """``(id, tie, ids, width)``: ids as little-endian integers of ``width`` bytes; ``tie`` orders rows of one id."""
    spark = docs.sparkSession
    content = file_bytes(spark, tokenizer_path)
    tokenizer = pretokens.load(content.value)
    whole = spark.sparkContext.broadcast(pretokens.whole_tokens(tokenizer))
    key = ("chunk-coder", tokenizer_path)

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = once(key, lambda: pretokens.ChunkCoder(content.value, whole.value))
        end = coder.pack([end_id])
        for texts in batches:
            yield pd.Series([coder.encode(t) + end for t in texts], dtype=object)

    text = text_or_empty(text_column)
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
    return docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(text).alias("tie"),
        encode(text).alias("ids"),
        F.lit(width).alias("width"),
    )


def _arrays(column: pa.Array, width: int) -> list[np.ndarray]:
    return [np.frombuffer(b, f"<u{width}") for b in column.to_pylist()] or [np.empty(0, f"<u{width}")]


def id_counts(ids: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each id occurs in the whole table; tasks send one count per id they have seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.concatenate(_arrays(batch.column(0), width)), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["symbol", "n"])

    counted = ids.select("ids").mapInArrow(count, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for symbol, n in counted.collect():  # one row per id of the vocabulary at most
        counts[symbol] = n
    return counts


@dataclass(frozen=True)
class _Ranges:
    """Which shard a row goes to: ranges of ids, and where one id fills several shards, ranges of its ties.

    Shard k holds the ids above bound k - 1 and up to bound k. An id that is several bounds has as many shards for itself, and
    ``ties`` holds the bounds between them; a tie that is several bounds is that of copies, which go to any of its shards.
    """

    bounds: np.ndarray
    ties: dict[int, np.ndarray]

    def shards_of(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.bounds, ids)
        for hot, cuts in self.ties.items():
            rows = np.flatnonzero(ids == hot)
            first, last = (np.searchsorted(cuts, ties[rows] >> _SHIFT, side) for side in ("left", "right"))
            # Copies take turns.
            part[rows] += first + np.arange(len(rows)) % np.maximum(1, last - first + (last - first > 0))
        return part.astype(np.int32)


# Spark's percentiles are doubles: ties are cut to what these hold exactly. Ids beyond 2**53 come in order all the same,
# but a single hot one among them is not split.
_SHIFT = 12
# Stands for a null id, which comes first.
_NULL = -(1 << 63)


def _ranges(ids: DataFrame, n_shards: int) -> _Ranges:
    """Bounds for rows ``(id, tie)``, a few numbers per shard."""
    number = F.coalesce("id", F.lit(_NULL))

    def cuts(rows: DataFrame, column: Column, parts: int, *by: Column) -> list:
        shares = [k / parts for k in range(1, parts)]
        return rows.groupBy(*by).agg(F.percentile_approx(column, shares, max(10_000, 20 * parts)).alias("cuts")).collect()

    if n_shards == 1:
        return _Ranges(np.zeros(0, np.int64), {})
    found = cuts(ids, number, n_shards)[0]["cuts"] or []
    values, times = np.unique(np.array(found, np.int64), return_counts=True)
    ties: dict[int, np.ndarray] = {}
    for parts in np.unique(times[times > 1]).tolist():
        hot = values[times == parts].tolist()
        for row in cuts(ids.filter(number.isin(hot)), F.shiftright("tie", _SHIFT), parts, number.alias("id")):
            ties[row["id"]] = np.array(row["cuts"], np.int64)
    return _Ranges(np.array(found, np.int64), ties)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_bits: int = 16,
    shard_bytes: int = 32 << 20,
    block_tokens: int = 1 << 18,
) -> None:
    """Tokenise every whole text, append ``end_id``, and write the ids in ascending order of the (integer) id column.

    Texts are tokenised once, where they are; only coded documents are exchanged. Shards are ranges of ids of about
    ``shard_bytes`` coded bytes; the rows of an id that has more, null ids among them, are ranges of the hash of
    their text, and copies of one row are dealt out. Null ids come first, null texts are empty ones (the end id alone),
    rows of one id are ordered by a hash of their text, an empty table gives tables without rows, and other columns are
    not read.
    """
    spark = docs.sparkSession
    stored = scratch_path(spark, "token-ids")
    tokenised = tokenize(docs, tokenizer_path, end_id, id_column, text_column)
    tokenised.write.option("compression", "zstd").parquet(stored)
    ids = spark.read.schema(tokenised.schema).parquet(stored)
    size, width = pretokens.load(file_bytes(spark, tokenizer_path).value).get_vocab_size(), 2
    if size > 1 << 16:
        width = 4
    counts = id_counts(ids, max(size, end_id + 1), width)
    used = int(np.count_nonzero(counts))
    lengths = code_lengths(counts, max(max_bits, used.bit_length()))
    n_shards = max(1, -(-int((counts * lengths).sum()) // (8 * shard_bytes)))
    shared = spark.sparkContext.broadcast((lengths, _ranges(ids, n_shards)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranges = shared.value
        encoder = Encoder(lengths)
        for batch in batches:
            pieces = _arrays(batch.column(2), width)
            coded = encoder.encode(pieces)
            filled = batch.column(0).fill_null(_NULL).to_numpy()
            part = ranges.shards_of(filled, batch.column(1).to_numpy())
            columns = [
                pa.array(part),
                batch.column(0),
                batch.column(1),
                pa.array([len(p) for p in pieces], pa.int64()),
                pa.array([c[0] for c in coded], pa.binary()),
                pa.array([c[1] for c in coded], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "id", "tie", "n_tokens", "payload", "marks"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_docs, size, first = [], 0, 0
        for batch in batches:
            for part, doc_id, _, n, payload, marks in zip(*(c.to_pylist() for c in batch.columns)):
                open_docs.append((part, doc_id, n, payload, marks))
                size += n
                if size >= block_tokens:
                    yield _block(open_docs, first)
                    open_docs, size, first = [], 0, first + size
        if open_docs:
            yield _block(open_docs, first)

    coded = ids.select("id", "tie", "ids").mapInArrow(
        encode, "part int, id long, tie long, n_tokens long, payload binary, marks binary"
    )
    placed = coded.repartitionById(n_shards, F.col("part")).sortWithinPartitions("id", "tie")
    placed.mapInArrow(assemble, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    shards = _read(spark, path, "blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards.write.parquet(f"{path}/shards")
    book = pd.DataFrame({"symbol": np.flatnonzero(lengths), "bits": lengths[lengths > 0].astype(np.int64)})
    spark.createDataFrame(book, "symbol long, bits long").coalesce(1).write.parquet(f"{path}/codebook")


def _block(docs: list[tuple], first: int) -> pa.RecordBatch:
    parts, doc_ids, tokens, payloads, marks = zip(*docs)
    shifts = np.cumsum([0, *(len(p) * 8 for p in payloads[:-1])])
    moved = [np.frombuffer(m, "<u8") + np.uint64(s) for m, s in zip(marks, shifts.tolist())]
    values = [
        pa.array([parts[0]], pa.int32()),
        pa.array([first], pa.int64()),
        pa.array([sum(tokens)], pa.int64()),
        pa.array([list(doc_ids)], pa.list_(pa.int64())),
        pa.array([list(tokens)], pa.list_(pa.int64())),
        pa.array([b"".join(payloads)], pa.binary()),
        pa.array([np.concatenate(moved).astype("<u8").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(
        values, ["shard", "first_token", "n_tokens", "doc_ids", "doc_tokens", "payload", "marks"]
    )


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    schemas = {"blocks": _BLOCKS, "shards": "shard int, n_tokens long, start long", "codebook": "symbol long, bits long"}
    return spark.read.schema(schemas[table]).parquet(f"{path}/{table}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from files alone; ``ids`` are little-endian unsigned 32-bit integers."""
    book = _read(spark, path, "codebook").collect()  # one row per id of the vocabulary at most
    lengths = np.zeros(max([1, *(r.symbol + 1 for r in book)]), np.uint8)
    for symbol, bits in book:
        lengths[symbol] = bits
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.array(row["doc_tokens"], np.int64)
                ids = decoder.decode(row["payload"], row["marks"], tokens).astype("<u4")
                ends = np.cumsum(tokens)
                starts = ends - tokens
                data = ids.tobytes()
                values = [
                    pa.array([row["shard"]] * len(tokens), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["first_token"], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(values, ["shard", "doc_id", "at", "n_tokens", "ids"])

    decoded = _read(spark, path, "blocks").mapInArrow(
        decode, "shard int, doc_id long, at long, n_tokens long, ids binary"
    )
    shards = _read(spark, path, "shards").select("shard", F.col("start").alias("shard_start"))
    return decoded.join(shards, "shard").select(
        "doc_id", (F.col("at") + F.col("shard_start")).alias("start"), "n_tokens", "ids"
    )
