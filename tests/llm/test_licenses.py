"""The license scan against its SQL form and against a plain version of it."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from textcurate.llm import licenses, oracles

SCHEMA = "doc_id long, text string, words string, row long, blocks string"
MIT, APACHE = licenses.TEMPLATES[1][1], licenses.TEMPLATES[3][1]


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", lowered)


def plain(rows, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    out = Counter()
    for doc_id, text, *_ in rows:
        w = plain_words(text)
        places, labels = [], set()
        for label, phrase in licenses.PHRASES:
            parts = phrase.split()
            here = [i for i in range(len(w)) if w[i : i + len(parts)] == parts]
            places += here
            labels |= {label} if here else set()
        base, score = sorted(labels), 0.0
        for label, template in templates:
            tokens = set(plain_words(template))
            c = 8
            while c < len(plain_words(template)):
                c *= 2
            for start in range(0, len(w), c):
                share = len(tokens & set(w[start : start + 2 * c])) / len(tokens)
                if share >= threshold - 1e-12:
                    labels.add(label)
                    score = max(score, share)
        first, last = (min(places), max(places)) if places else (None, None)
        out[doc_id, len(w), len(places), first, last, ",".join(base), ",".join(sorted(labels)), score] += 1
    return out


def edited(text, share, pick):
    return " ".join(w if pick.random() > share else pick.choice(["xx", "the", "", "of license"]) for w in text.split())


def make_rows():
    pick = random.Random(4)
    filler = "the of and software license public general mit apache released under é 日本 version 3 0 Ünder".split()
    rows = [
        (1, None),
        (2, ""),
        (3, "..."),
        (3, "..."),
        (None, "MIT License"),
        (4, "mit license MIT LICENSE mit-license general public\nlicense"),
        (5, "Mİt license and Kir mitK license É general  public. License"),
        (6, "licensed under cc by nc 4 0"),
        (7, MIT),
        (8, "words " * 700 + APACHE + " and " + MIT + " words" * 300),
        (9, "license " * 3000),
        (9, "released under the mit license " * 400),
        (10, "😀 " * 20 + "Released under the MIT License. 😀"),
        (11, "a" * 30000),
    ]
    for k in range(60):
        _, template = pick.choice(licenses.TEMPLATES)
        pad = [" ".join(pick.choice(filler) for _ in range(pick.randint(0, 90))) for _ in range(2)]
        rows.append((20 + k // 2, f"{pad[0]} {edited(template, pick.choice([0, 0.05, 0.12, 0.2, 0.3]), pick)} {pad[1]}"))
    return [(*r, "a", 1, "b") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.mark.parametrize("threshold", [0.3, 0.5, licenses.THRESHOLD, 1.0])
def test_scan_equals_plain_version(spark, rows, threshold):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = licenses.scan(docs, threshold=threshold)
    assert Counter(tuple(r) for r in found.collect()) == plain(rows, threshold=threshold)


def test_sql_form_equals_plain_version(rows):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert Counter(connection.execute(oracles.license_scan()).fetchall()) == plain(rows)


def test_own_templates_and_none(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    own = [("one", "words"), ("two", "words words of"), ("ä", "É 日本")]
    assert Counter(tuple(r) for r in licenses.scan(docs, own, 0.5).collect()) == plain(rows, own, 0.5)
    assert Counter(tuple(r) for r in licenses.scan(docs, []).collect()) == plain(rows, [])
    for label, text, threshold in (("no words", "...", 0.5), ("no threshold", "mit", 0.0)):
        with pytest.raises(ValueError):
            licenses.Template.of(label, text, threshold)


def test_need_is_exact():
    for n in range(1, 60):
        for threshold in (0.8, 0.85, 0.9, 2 / 3):
            template = licenses.Template.of("x", " ".join(f"w{k}" for k in range(n)), threshold)
            assert template.need == min(k for k in range(1, n + 1) if k / n >= threshold - 1e-12)
            assert len(template.prefix({w: k for k, w in enumerate(sorted(template.words))})) == n - template.need + 1
            assert template.block >= max(8, n) and math.log2(template.block).is_integer()


def test_only_blocks_with_rare_words_are_built(spark):
    """Common words alone never make a block: the word order comes from the documents."""
    docs = spark.createDataFrame([(k, "the of and license a text under version public" * 20) for k in range(50)], "doc_id long, text string")
    order = licenses.word_order(docs, {"the", "license", "sublicense", "merge"})
    assert order == ["merge", "sublicense", "license", "the"]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
