"""A pipeline over ``documents``: each stage works on what the one before it kept and wrote.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.llm import decontaminate, language, ngram_join, pieces, secrets
from textcurate.plans.scratch import materialize
from textcurate.plans.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language has a smaller posterior is of no language that was learned.
LEAST_POSTERIOR = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, a text, or a language that stands out are rejected; the others stay as they are.

    Ids may be null or repeated, each row is judged by its text; of an empty table, or one without languages, none stays.
    """
    ship(spark)
    model = language.train(docs.filter(~language.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    row = F.struct(*COLUMNS).alias("row")
    found = language.predict(docs.select(row, "text"), model, id_column="row")
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR)
    return found.filter(known).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of Jaccard similarity lead through, one row stays: the smallest id, null ids last.

    Rows are told apart by a number, not by their ids, which may be null, repeated or shared by different texts.
    """
    ship(spark)
    rows = ngram_join.numbered(docs, *COLUMNS)
    return rows.join(ngram_join.first_rows(rows), "row", "left_semi").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or edited, go.

    Null and empty texts hold none and stay, repeated rows go or stay alike, and an empty benchmark leaves all.
    """
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = docs.select(*COLUMNS, decontaminate.found_items(docs, benchmark).alias("_found"))
    return found.filter(F.size("_found") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; all documents stay, repeated rows each. ``n_chars`` follows the text.

    Texts without a secret, null ones too, are left as they are; an empty table stays empty.
    """
    model = secrets.train(secrets.labelled_samples(docs))
    row = F.struct(*COLUMNS).alias("row")
    found = secrets.find_secrets(docs.select(row, "text"), model, id_column="row")
    spans = F.concat("base", "added")
    masked = F.when(F.size(spans) > 0, secrets.redact(F.col("text"), spans)).otherwise(F.col("row.text"))
    n_chars = F.when(F.size(spans) > 0, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))
    found = found.select("row", "base", "added", masked.alias("masked"))
    return found.select("row.doc_id", F.col("masked").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, each row by itself; null and empty texts have none."""
    ship(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode_pieces),
]

#: Models and segmentations are not SQL; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
