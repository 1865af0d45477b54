"""Token alignment against a plain version of it."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textcurate.llm import alignment, csr, pretokens

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "the", "xq", "\x1c", "1", "!", "'s", "<|endoftext|>", "<s>", "<0x41>", "՘", "日本", "é", "😀", "▁", "\x00", "zzzzz"]


class Plain:
    """Both libraries and dictionaries."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.to_byte = {c: b for b, c in pretokens.byte_alphabet().items()}

    def a_bytes(self, i):
        return bytes(self.to_byte[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = (" " + text).encode()
        if b"".join(map(self.a_bytes, a)) != raw or b"".join(map(self.b_bytes, b)) != raw:
            return [], []
        return a, b

    def align(self, text):
        a, b = self.tokens(text)
        a_ends, b_ends = np.cumsum([len(self.a_bytes(i)) for i in a]), np.cumsum([len(self.b_bytes(i)) for i in b])
        cuts = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        groups = [([], []) for _ in cuts]
        for side, ends in ((0, a_ends), (1, b_ends)):
            for place, end in enumerate(ends.tolist()):
                groups[next(g for g, cut in enumerate(cuts) if end <= cut)][side].append(place)
        links, b_starts = [], [0, *b_ends.tolist()]
        for i, (start, end) in enumerate(zip([0, *a_ends.tolist()], a_ends.tolist())):
            for j in range(len(b)):
                common = min(end, b_starts[j + 1]) - max(start, b_starts[j])
                if common > 0:
                    links.append((i, j, common))
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    mixed = ["".join(pick.choice(PARTS) for _ in range(pick.randint(1, 12))) for _ in range(60)]
    return [None, "", " ", "a", "a", "▁", "x ", " lead", "two  spaces here", "plain words of a text, plain words", *mixed]


@pytest.fixture(scope="module")
def rows(texts):
    # Ids that are null, repeated, or shared by different texts.
    return [(None if k % 9 == 0 else k // 2, text, "a", 1.0) for k, text in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, links string, block double").repartition(3)


def test_products_equal_dense_ones():
    random_ = np.random.default_rng(2)
    for rows, inner, columns in ((7, 9, 5), (1, 1, 1), (40, 3, 60), (3, 4, 0)):
        left, right = random_.random((rows, inner)) < 0.4, random_.random((inner, columns)) < 0.4
        a, b = (
            csr.Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in (left, right)
        )
        for at_once in (1, 5, 1000):
            dense = np.zeros((rows, columns), int)
            for i, j, value in csr.row_products(a, b, at_once):
                dense[i, j] = value
            assert (dense == left.astype(int) @ right.astype(int)).all()
        assert csr.product_terms(a, b).tolist() == (left.astype(int) @ right.sum(axis=1)).tolist()
        back = b.transposed()
        assert [back.indices[x:y].tolist() for x, y in zip(back.indptr, back.indptr[1:])] == [
            np.flatnonzero(c).tolist() for c in right.T
        ]


def test_piece_encoder_equals_the_library(plain):
    encoder = alignment.PieceEncoder(open(B, "rb").read())
    assert encoder.chunked
    pick = random.Random(8)
    for _ in range(1500):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == plain.b.encode(text)


def test_align_equals_plain_version(plain, docs, rows):
    found = Counter(
        (
            r.doc_id,
            tuple(r.a_ids),
            tuple(r.b_ids),
            tuple(r.a_groups),
            tuple(r.b_groups),
            tuple(tuple(x) for x in r.links),
            tuple(tuple(x) for x in r.shared),
        )
        for r in alignment.align(docs, A, B).collect()
    )
    expected = Counter()
    for doc_id, text, *_ in rows:
        a, b, groups, links = plain.align(text)
        number = [{p: g for g, group in enumerate(groups) for p in group[side]} for side in (0, 1)]
        shared = [(i, j) for i in range(len(a)) for j in range(len(b)) if number[0][i] == number[1][j]]
        sides = [tuple(number[side][p] for p in range(len(ids))) for side, ids in ((0, a), (1, b))]
        expected[doc_id, tuple(a), tuple(b), *sides, tuple(links), tuple(shared)] += 1
    assert found == expected


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_corpus_scores_equal_plain_version(plain, docs, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(alignment, "GROUP_BYTES", min(100, block_bytes))
    corpus = alignment.LinkedCorpus(docs, A, B)
    aligned = [(doc_id, *plain.align(text)) for doc_id, text, *_ in rows]
    pairs = Counter(p for _, a, b, _, links in aligned for p in {(a[i], b[j]) for i, j, _ in links})
    highest = Counter()
    for (a, _), n in pairs.items():
        highest[a] = max(highest[a], n)
    counts = {(r.a_id, r.b_id): (r.documents, r.best) for r in corpus.counts().collect()}
    assert counts == {p: (n, n == highest[p[0]]) for p, n in pairs.items()}
    expected = Counter()
    for doc_id, a, b, groups, links in aligned:
        linked = [(a[i], b[j]) for i, j, _ in links]
        spelled = ";".join(
            f"{','.join(str(a[i]) for i in left)}|{','.join(str(b[j]) for j in right)}" for left, right in groups
        )
        expected[
            doc_id,
            len(a),
            len(b),
            len(groups),
            len(links),
            sum(len(left) * len(right) for left, right in groups),
            hashlib.sha256(spelled.encode()).hexdigest() if a else "",
            sum(pairs[p] == highest[p[0]] for p in linked),
            sum(pairs[p] for p in linked),
        ] += 1
    assert Counter(tuple(r) for r in corpus.scores().collect()) == expected


def test_long_text_and_empty_table(spark, plain):
    text = "long words of <|endoftext|> and 日本 " * 30000
    docs = spark.createDataFrame([(1, text), (2, "long words")], "doc_id long, text string")
    found = {r.doc_id: r for r in alignment.LinkedCorpus(docs, A, B).scores().collect()}
    a, b = plain.tokens(text)
    assert (found[1].n_a, found[1].n_b) == (len(a), len(b)) and found[1].n_links >= len(a)
    none = docs.filter("doc_id = 9")
    assert alignment.LinkedCorpus(none, A, B).scores().count() == 0 and alignment.align(none, A, B).count() == 0
    only_null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = alignment.LinkedCorpus(only_null, A, B).scores().first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, "", 0, 0)
