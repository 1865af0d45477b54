"""Shuffled shards by a two-pass external shuffle, in DataFrame functions only.

The first pass scatters records uniformly into buckets that fit memory, by a seeded hash. The second shuffles each bucket
by itself (Spark's ``shuffle`` is a Fisher-Yates shuffle) and writes it. The order is that of the buckets, then of
the records within them; shards are consecutive runs of it whose counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textcurate.llm.support import text_or_empty
from textcurate.plans.scratch import materialize

# The finest scatter. Buckets are runs of cells, so that one pass over the texts sizes buckets of any number.
CELL_BITS = 24
# Buckets grow up to four times when this many would be more; beyond that there are more of them, as many as it takes.
MANY_BUCKETS = 1 << 16
# Copies of one row that a task writes out at a time.
COPIES = 1000


def _cell(hashed: Column) -> Column:
    # High bits are used: each hash is as good in all of its bits.
    return F.shiftrightunsigned(hashed, 64 - CELL_BITS).cast("int")


def _bucket_count(total: int, bucket_bytes: int) -> int:
    buckets = max(1, -(-total // bucket_bytes))
    if buckets > MANY_BUCKETS:
        buckets = max(MANY_BUCKETS, -(-total // (4 * bucket_bytes)))
    if buckets > 1 << CELL_BITS:
        raise ValueError(f"{total} bytes need more than {1 << CELL_BITS} buckets; set larger ones")
    return buckets


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write ``(id, text, slot)`` as Parquet to ``path``, one folder ``shard=<n>`` per shard (law ``rows``).

    Every row is kept, repeated rows too. A null text stays null and has size 8. Copies of a text under several ids are
    scattered like any others. Rows of one id and text would share a bucket; where they are more than a bucket holds, they
    are numbered and scattered one by one. An empty table writes no shard. Other columns are left out. The result depends
    on the seed and the rows alone, not on their partitions. A text longer than a bucket is a bucket of its own.
    """
    text = text_or_empty(text_column)
    # The text tells rows of one id apart.
    hashed = F.xxhash64(F.lit(seed), F.col(id_column), text).alias("hash")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), hashed)
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")
    cells = rows.select(_cell(F.col("hash")).alias("cell"), size).groupBy("cell")
    cells = materialize(cells.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-cells")
    total, count = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = _bucket_count(total, bucket_bytes)

    # Cells that alone fill a bucket, so no more than there are buckets: nearly always copies of a row.
    heavy = cells.filter((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select("cell")
    if not heavy.isEmpty():
        marked = rows.withColumn("cell", _cell(F.col("hash")))
        heavy = F.broadcast(heavy)
        # Copies are counted where they lie, before anything moves.
        same = marked.join(heavy, "cell", "left_semi").groupBy("id", "text", "hash").agg(F.count("*").alias("copies"))
        same = materialize(same, "repeated-rows")
        runs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES))).alias("run")
        runs = same.select("id", "text", "hash", "copies", runs)
        first = F.col("run") * COPIES
        number = F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)).alias("copy")
        own = F.xxhash64(F.lit(seed), F.col("hash"), F.col("copy")).alias("hash")
        # Which cells they go to is worked out without their texts.
        moved = runs.select("hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "run", "copies")
        moved = moved.repartition("hash", "run").select("hash", "size", number).select(_cell(own).alias("cell"), F.lit(1).alias("n"))
        light = cells.join(heavy, "cell", "left_anti").select("cell", "n")
        cells = light.unionByName(moved).groupBy("cell").agg(F.sum("n").alias("n"))
        scattered = runs.repartition("hash", "run").select("id", "text", "hash", number).select("id", "text", own)
        rows = marked.join(heavy, "cell", "left_anti").select("id", "text", "hash").unionByName(scattered)

    def bucket(of: Column) -> Column:
        return F.floor(of.cast("long") * buckets / (1 << CELL_BITS)).cast("int")

    counts = cells.groupBy(bucket(F.col("cell")).alias("bucket")).agg(F.sum("n").alias("n"))
    # One short row per bucket here and in the broadcast below: 16 bytes for 32 MB of texts or more.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))

    tie = F.xxhash64(F.lit(seed + 1), F.col("hash")).alias("tie")
    record = F.struct(tie, "id", "text")
    # Sorting first makes the shuffle depend on the records and not on the order in which they arrive.
    # One partition per bucket: a partition's random numbers follow from the seed and its number alone.
    bucketed = rows.select(bucket(_cell(F.col("hash"))).alias("bucket"), record.alias("record"))
    bucketed = bucketed.repartitionById(int(buckets), F.col("bucket"))
    piles = bucketed.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records"))
    mixed = piles.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record"))
    placed = mixed.join(F.broadcast(starts), "bucket").withColumn("rank", F.col("start") + F.col("place"))

    # The first ``more`` shards have ``least`` + 1 records, the others ``least``.
    least, more = count // shards, count % shards
    edge = more * (least + 1)
    late = F.col("rank") - edge
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (least + 1))).otherwise(
        F.floor(late / max(1, least)) + more
    )
    slot = F.when(F.col("rank") < edge, F.col("rank") % (least + 1)).otherwise(late % max(1, least))
    out = placed.select(
        F.col("record.id").alias(id_column),
        F.col("record.text").alias(text_column),
        slot.cast("long").alias("slot"),
        shard.cast("int").alias("shard"),
    )
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(
    spark: SparkSession, path: str, docs_schema, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, text, slot, shard)`` of all shards."""
    kind = docs_schema[id_column].dataType.simpleString()
    return spark.read.schema(f"`{id_column}` {kind}, `{text_column}` string, slot long, shard int").parquet(path)


def digest(shards: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Size and checksum of each record, and its place."""
    text = text_or_empty(text_column)
    return shards.select(
        id_column,
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
