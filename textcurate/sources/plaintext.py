"""Plain text and Markdown: one row per paragraph, or per line in files with fewer than three paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textcurate.functions.text import strip
from textcurate.operators.rowindex import tag_file_position
from textcurate.plans.scratch import materialize
from textcurate.plans.skew import join_on_unique
from textcurate.schema import BLOCK, FILE, LINE, PLACE

MIN_PARAGRAPHS = 3
# Line breaks that end a line of text although they do not end a record of a text file.
_INNER_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def split_paragraphs(text: Column) -> Column:
    """The paragraphs of one string (or its lines, where there are fewer than three), stripped, blank ones dropped."""
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(unified, pattern), strip), lambda p: p != "")

    paragraphs = parts("\n\n")
    # Few texts have the rarer line breaks, and the plain split is much faster.
    lines = F.when(text.rlike(_INNER_BREAKS), parts(f"[\n{_INNER_BREAKS[1:]}")).otherwise(parts("\n"))
    return F.when(F.size(paragraphs) >= MIN_PARAGRAPHS, paragraphs).otherwise(lines)


def read_plaintext(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``text`` with their place in the source. Files are read in splits, so one may be larger than a task.

    A paragraph is a run of non-empty lines: two lines belong together when the same number of empty lines stands
    before both in the file. That number is a running sum inside each split plus the empty lines of earlier splits.
    """
    lines = tag_file_position(spark.read.text(path)).select(
        FILE, BLOCK, F.monotonically_increasing_id().alias(PLACE), F.make_valid_utf8("value").alias("line")
    )
    lines = materialize(lines, "lines")

    empty = (F.col("line") == "").cast("long")
    splits = lines.groupBy(FILE, BLOCK).agg(F.sum(empty).alias("_empty"))
    earlier = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(FILE, BLOCK, F.coalesce(F.sum("_empty").over(earlier), F.lit(0)).alias("_before"))

    # A window group is one split, so spark.sql.files.maxPartitionBytes bounds it.
    running = Window.partitionBy(FILE, BLOCK).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_here", F.sum(empty).over(running)).join(splits, [FILE, BLOCK])
    numbered = numbered.filter(F.col("line") != "").withColumn("_para", F.col("_before") + F.col("_here"))
    numbered = materialize(numbered.drop("_before", "_here"), "numbered-lines")

    # Which way a file is cut is settled before any paragraph is put together: a file without empty lines would
    # otherwise be collected whole.
    filled = numbered.filter(strip(F.col("line")) != "").select(FILE, "_para").distinct()
    counts = filled.groupBy(FILE).agg((F.count("*") >= MIN_PARAGRAPHS).alias("_by_paragraph"))
    cut = join_on_unique(numbered, counts, FILE)

    paragraphs = (
        cut.filter("_by_paragraph")
        .groupBy(FILE, "_para")
        .agg(F.sort_array(F.collect_list(F.struct(BLOCK, PLACE, "line"))).alias("_lines"))
        .select(
            FILE,
            F.col("_lines")[0][BLOCK].alias(BLOCK),
            F.col("_lines")[0][PLACE].alias(PLACE),
            F.lit(0).alias(LINE),
            strip(F.array_join("_lines.line", "\n")).alias("text"),
        )
    )
    single = cut.filter("NOT _by_paragraph").select(
        FILE, BLOCK, PLACE, F.posexplode(F.split("line", _INNER_BREAKS)).alias(LINE, "text")
    )
    single = single.withColumn("text", strip(F.col("text")))
    rows = paragraphs.unionByName(single).filter(F.col("text") != "")
    if rows.isEmpty():
        raise ValueError(f"{path} holds no text")
    return rows
