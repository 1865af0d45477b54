"""Scalar functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcurate.functions.text import cache_key, coerce_bool, normalize_text, row_json, snippet, strip


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,plain",
    [
        ("‘a’ ‹b›", "'a' 'b'"),
        ("“a” «b»", '"a" "b"'),
        ("1–2—3", "1-2-3"),
        ("wait…", "wait..."),
        ("• a · b", "* a . b"),
        ("a b", "a b"),
        ("→ ←", "-> <-"),
        ("® ©", "(R) (c)"),
        ("ﬁne ½ Ａ", "fine 1⁄2 A"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, text, plain):
    assert one(spark, text, normalize_text) == plain


def test_cache_key_is_a_hash_of_model_and_text(spark):
    expected = hashlib.sha256("mé".encode() + b"\x00" + "tëxt".encode()).hexdigest()
    assert one(spark, "tëxt", lambda c: cache_key("mé", c)) == expected


def test_snippet_length(spark):
    assert one(spark, "x" * 240, snippet) == "x" * 240
    assert one(spark, "é" * 241, snippet) == "é" * 239 + "…"


@pytest.mark.parametrize("text", ["\t a \n", "  a　", "\x1ca\x1f", "\x85a b ", "  ", "a"])
def test_strip_is_like_python(spark, text):
    assert one(spark, text, strip) == text.strip()


WORDS = {"TRUE": True, " yes ": True, "Y": True, "t": True, "1": True, "Keep": True, "0": False, "drop": False, "": False}


@pytest.mark.parametrize("word,truth", [*WORDS.items(), (None, True)])
def test_words_as_booleans(spark, word, truth):
    assert one(spark, word, lambda c: coerce_bool(c, T.StringType())) is truth


@pytest.mark.parametrize("value,truth", [(0.0, False), (2.5, True), (math.nan, True), (None, True)])
def test_numbers_as_booleans(spark, value, truth):
    assert one(spark, value, lambda c: coerce_bool(c, T.DoubleType()), "double") is truth


def test_row_json_writes_missing_values_as_null(spark):
    rows = spark.createDataFrame([(1, math.nan, None, True, "é")], "a int, b double, c string, d boolean, e string")
    assert rows.select(row_json(rows.schema)).first()[0] == '{"a":1,"b":null,"c":null,"d":true,"e":"é"}'
