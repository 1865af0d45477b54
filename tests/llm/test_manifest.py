"""The Merkle manifest against a plain version of it."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textcurate.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lo string, tree int, path double"
UPPER = {c: c + 32 for c in range(65, 91)}


def digest(*values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def h(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain(rows, fanout=8):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` per row."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h(below[i : i + fanout]) for i in range(0, len(below), fanout)])
        return levels

    def climb(levels, place, digest_, met):
        for level in levels[:-1]:
            run = level[place // fanout * fanout :][:fanout]
            own = place % fanout
            met += run[:own] + run[own + 1 :]
            digest_ = h([*run[:own], digest_, *run[own + 1 :]])
            place //= fanout
        return digest_

    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = digest(doc_id, source, lang, n_chars, text)
        changed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = digest(doc_id, source, lang, n_chars, None if text is None else text.translate(UPPER))
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        trees[name] = tree([r[2] for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    out = Counter()
    for at, name in enumerate(names):
        for place, (_, _, leaf, doc_id, changed) in enumerate(groups[name]):
            met = []
            folded = climb(top, at, climb(trees[name], place, changed, met), met)
            root = top[-1][0]
            out[doc_id, leaf, trees[name][-1][0], root, h(met), folded, folded == root] += 1
    return out


def rows_of(sizes):
    rows = []
    for lang, n in sizes.items():
        for k in range(n):
            doc_id = None if k % 17 == 3 else k * 7 % 1000 + len(rows)
            text = [None, "", "Plain Text", "ÄÖ Ünicode 日本 😀", "x" * 5000][k % 5]
            rows.append((doc_id, text, lang, None if k % 4 == 0 else f"s{k % 3}", None if k % 6 == 0 else k, "a", 1, 0.5))
    return rows


CASES = {
    "sizes": rows_of({"en": 200, None: 9, "de": 8, "fr": 1, "": 65, "é": 2, "zz": 64, "Z": 7, "a": 1}),
    "one row": rows_of({"en": 1}),
    "one null language": rows_of({None: 10}),
    "copies": [(5, "Copy", "en", "s", 4, "a", 1, 0.5)] * 150 + [(None, None, None, None, None, None, None, None)] * 70,
    "one id, many texts": [(5, f"Text {k}", "en", "s", 4, "a", 1, 0.5) for k in range(70)],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_plain_version(spark, tmp_path, name):
    rows = CASES[name]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in found.collect()) == plain(rows)


def test_fanout_and_intervals(spark):
    rows = rows_of({"en": 30, None: 5})
    built = manifest.build(spark.createDataFrame(rows, SCHEMA), fanout=2)
    nodes = built.nodes().collect()
    by_level = Counter((r.tree, r.level) for r in nodes)
    assert [by_level["=en", k] for k in range(7)] == [30, 15, 8, 4, 2, 1, 0] and by_level["", 3] == 1
    for r in nodes:
        assert r.lo % 2**r.level == 0 and r.hi == min(r.lo + 2**r.level, 30 if r.tree else 5)
    proofs = built.proofs()
    assert proofs.count() == 35
    wrong = manifest.verify(proofs, F.col("leaf")).filter("NOT verified").count()
    assert wrong == 0


def test_range_limits_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(CASES["sizes"], SCHEMA).repartition(3)
    before = {tuple(r) for r in manifest.verify(manifest.build(docs).proofs(), F.col("leaf")).collect()}
    monkeypatch.setattr(manifest, "PARTITION_LEAVES", 20)
    assert {tuple(r) for r in manifest.verify(manifest.build(docs).proofs(), F.col("leaf")).collect()} == before


def test_empty_table(spark):
    built = manifest.build(spark.createDataFrame([], SCHEMA))
    assert built.root is None and built.nodes().count() == 0 and built.proofs().count() == 0
