"""One query per operator of this subpackage: it applies the operator to its whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.llm import (
    alignment,
    decontaminate,
    language,
    licenses,
    manifest,
    ngram_join,
    oracles,
    permutation_index,
    pieces,
    pii,
    secrets,
    sharding,
)
from textcurate.llm.token_counts import token_counts
from textcurate.llm.token_files import read_token_files, write_token_files
from textcurate.plans.scratch import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stands in for a key that the owner of the data keeps.
_PII_KEY = "pseudonym key of the example queries"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), _PII_KEY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.digest(secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs))))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every text, and a checksum of what they spell, which is that of the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), path)
    encoded = encoded.withColumn("key", F.struct("doc_id", "n_pieces", "score", F.xxhash64("ids").alias("ids_hash")))
    spelled = pieces.decode(encoded, path, id_column="key")
    return spelled.select("key.*", F.crc32(F.encode("text", "utf-8")).alias("text_crc32"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, path)
    return sharding.digest(sharding.read_shards(spark, path, docs.schema))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.LinkedCorpus(_table(spark, sf_dir, "documents"), a, b).scores()


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row, by its id's checksum, is verified with its text in lower case."""
    docs = _table(spark, sf_dir, "documents")
    upper = string.ascii_uppercase
    changed = [F.translate(f, upper, upper.lower()) if f == "text" else F.col(f) for f in manifest.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.record_digest(changed))
    proofs = manifest.build(docs, extra=tampered).proofs()
    found = manifest.verify(proofs, F.coalesce("extra", "leaf"))
    return found.withColumnRenamed("id", "doc_id")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES = {name: value for name, value in list(globals().items()) if name.startswith("op")}
ORACLE_SQL = {"op12_merkle_manifest": oracles.merkle(), "op13_license_scan": oracles.license_scan()}
