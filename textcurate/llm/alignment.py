"""Alignment of two tokenizers over the same bytes.

Tokens of a byte-level BPE (A, of a space and the text) and pieces of a SentencePiece BPE (B, which adds that space
itself) both cover the bytes of space + text. Each tokenizer gives a 0/1 matrix of tokens against bytes, in compressed
sparse rows; the row products of A·Bᵀ are the overlaps, entry by entry the number of bytes that two tokens share. Bytes at
which tokens of both end cut the text into groups, and the product of the two group matrices links tokens that share one.

Link counts over a corpus are worked out by blocks: a block lists the different linked id pairs of its documents once, and
only these lists are counted, joined and brought back to the block. A pair comes up at most once a block, so that
no pair is a hot key, however common it is.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.llm import pretokens
from textcurate.llm.csr import Csr, membership, product_terms, row_products, spans
from textcurate.llm.support import file_bytes, once, text_or_empty
from textcurate.plans.scratch import materialize

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Words remembered per Python worker; once as many are, the table is emptied, which costs time and no results.
MAX_WORDS = 200_000
# Texts that are aligned at once, and texts that share a list of pairs: a longer text is alone.
GROUP_BYTES, BLOCK_BYTES = 1 << 19, 16 << 20


class PieceEncoder(dict):
    """Ids of SentencePiece pieces, equal to the library's; remembers words (without the mark in front of them).

    Where no piece crosses from other characters into a mark, no merge does, and a text is the sum of its chunks, which
    are marks and the other characters behind them. A model with such a piece, or one that rewrites texts, gets whole texts.
    """

    def __init__(self, model: bytes):
        self.own = own = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        every = "".join(map(chr, [*range(0x21, 0x2581), *range(0x2582, 0xD800), *range(0xE000, 0xFFFE)]))
        kept = own.normalize(f"  {every}  \t {every} ") == f"{MARK * 3}{every}{MARK * 2}\t{MARK}{every}{MARK}"
        mark = own.piece_to_id(MARK)
        self.chunked = kept and not own.is_unknown(mark) and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.mark = np.array([mark], "<i4").tobytes()
        self.content = []
        for i, piece in enumerate(pieces):
            if own.is_byte(i):
                self.content.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.content.append(piece.replace(MARK, " ").encode())

    def _whole(self, text: str) -> bytes:
        return array("i", self.own.encode(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        value = self._whole(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def learn(self, texts: list[str]) -> None:
        """Encode the new words of several texts in one call."""
        if not self.chunked:
            return
        if len(self) >= MAX_WORDS:
            self.clear()
        words = {word for text in texts for word in text.split(" ")}
        new = [word for word in words if word not in self and len(word) <= 64 and MARK not in word]
        for word, ids in zip(new, self.own.encode(new, num_threads=1)):
            self[word] = array("i", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # The library puts the first mark back; of nothing but that mark it would make nothing.
        return self.mark if chunk == MARK else self[chunk[1:].replace(MARK, " ")]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; empty for the empty text."""
        if not text:
            return b""
        if not self.chunked or MARK in text:
            return self._whole(text)
        if "  " not in text and text[0] != " " != text[-1]:
            return b"".join(map(self.__getitem__, text.split(" ")))
        return b"".join(map(self._chunk, _CHUNKS.findall(MARK + text.replace(" ", MARK))))


class _Spelling:
    """The bytes of every id, end to end."""

    def __init__(self, content: list[bytes]):
        self.sizes = np.array([len(c) for c in content], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(content), np.uint8)

    def misspelt(self, ids: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Places where the bytes of the ids differ from ``raw``, which is as long as they are."""
        wrong = [np.zeros(0, np.int64)]
        for at in range(0, len(ids), 1 << 17):
            part, stop = ids[at : at + (1 << 17)], ends[at : at + (1 << 17)]
            first, sizes = int(stop[0] - self.sizes[part[0]]), self.sizes[part]
            place = np.arange(first, int(stop[-1])) + np.repeat(self.starts[part] - (stop - sizes), sizes)
            wrong.append(first + np.flatnonzero(self.flat[place] != raw[first : int(stop[-1])]))
        return np.concatenate(wrong)


@dataclass(frozen=True)
class Aligned:
    """Both tokenizations of several texts, end to end; ``a_texts[t] : a_texts[t + 1]`` are the tokens of text ``t``."""

    a: np.ndarray
    b: np.ndarray
    a_texts: np.ndarray
    b_texts: np.ndarray
    a_bytes: Csr
    b_bytes: Csr
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of overlapping tokens, and the bytes they share: the rows of A·Bᵀ."""
        return row_products(self.a_bytes, self.b_bytes.transposed())

    def _group_matrices(self) -> tuple[Csr, Csr]:
        return membership(self.a_group, self.groups), membership(self.b_group, self.groups).transposed()

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of tokens of one group: the rows of the product of the group matrices."""
        return row_products(*self._group_matrices())

    def shared_counts(self) -> np.ndarray:
        """How many tokens of B share the group of each token of A."""
        return product_terms(*self._group_matrices())

    def text_of(self, a_places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a_texts, a_places, side="right") - 1

    def group_strings(self) -> list[str]:
        """Per text the ids of each group, ``a,a|b,b``, joined by semicolons."""
        # Each token is followed by a comma, or by what ends its side of the group.
        a_last = np.diff(self.a_group, append=self.groups) > 0
        b_last = np.diff(self.b_group, append=self.groups) > 0
        a_sizes = np.bincount(self.a_group, minlength=self.groups)
        b_sizes = np.bincount(self.b_group, minlength=self.groups)
        a_at = np.arange(len(self.a)) + (np.cumsum(b_sizes) - b_sizes)[self.a_group]
        b_at = np.arange(len(self.b)) + np.cumsum(a_sizes)[self.b_group]
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[a_at] = self.a * 3 + a_last
        code[b_at] = self.b * 3 + 2 * b_last
        spelled = [f"{n // 3}{',|;'[n % 3]}" for n in np.unique(code).tolist()]
        parts = np.array(spelled, object)[np.unique(code, return_inverse=True)[1]].tolist()
        ends = (self.a_texts + self.b_texts).tolist()
        return ["".join(parts[first:last])[:-1] for first, last in zip(ends, ends[1:])]


class Aligner:
    def __init__(self, a_json: bytes, b_model: bytes):
        self.a = pretokens.ChunkCoder(a_json, {})
        self.a.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.b = PieceEncoder(b_model)
        to_byte = {c: b for b, c in pretokens.byte_alphabet().items()}
        vocabulary = {i: s for s, i in self.a.tokenizer.get_vocab().items()}
        content = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        # An entry that is not in the byte alphabet (a special token) is never met; it spells itself.
        self.a_spelling = _Spelling(
            [bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode() for s in content]
        )
        self.b_spelling = _Spelling(self.b.content)

    def align(self, texts: list[str]) -> Aligned:
        """Texts that are empty, or that either tokenizer spells otherwise, have no tokens."""
        self.b.learn(texts)
        raw = [b" " + t.encode() if t else b"" for t in texts]
        sides = []
        for kind, found in (
            (self.a.width, [self.a.encode(" " + t) if t else b"" for t in texts]),
            ("i", [self.b.encode(t) for t in texts]),
        ):
            ids = np.frombuffer(b"".join(found), f"<{kind.lower() if kind == 'i' else kind}")
            sizes = np.array([len(f) for f in found], np.int64) // ids.itemsize
            sides.append((ids.astype(np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])))
        lengths = np.array([len(r) for r in raw], np.int64)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        joined = np.frombuffer(b"".join(raw), np.uint8)
        wrong, all_ends = np.zeros(len(texts), bool), []
        for (ids, offsets), spelling in zip(sides, (self.a_spelling, self.b_spelling)):
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(spelling.sizes[ids])])
            wrong |= np.diff(ends[offsets]) != lengths
            if not wrong.any():
                places = spelling.misspelt(ids, ends[1:], joined)
                wrong[np.searchsorted(bounds, places, side="right") - 1] = True
            all_ends.append(ends[1:])
        if wrong.any():
            return self.align(["" if bad else text for text, bad in zip(texts, wrong.tolist())])
        (a, a_texts), (b, b_texts) = sides
        a_ends, b_ends = all_ends
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        return Aligned(
            a,
            b,
            a_texts,
            b_texts,
            spans(a_ends),
            spans(b_ends),
            np.searchsorted(common, a_ends),
            np.searchsorted(common, b_ends),
            len(common),
        )


def _aligner(a_file, b_file, a_path: str, b_path: str) -> Aligner:
    return once(("aligner", a_path, b_path), lambda: Aligner(a_file.value, b_file.value))


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``GROUP_BYTES``, or of one longer text, with the place of the first."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > GROUP_BYTES:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if texts:
        yield first, texts[first:]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def align(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, a_ids, b_ids, a_groups, b_groups, links, shared)`` per row of ``docs``.

    ``a_path`` is a byte-level BPE in a ``tokenizers`` JSON file, ``b_path`` a SentencePiece model that adds a space. Groups
    are numbered from 0 within a text. ``links`` lists the places ``(a, b)`` of overlapping tokens and the ``bytes`` they
    share, ``shared`` the places of tokens of one group. A text that is null or empty, or that either tokenizer does not
    spell as it is, has empty lists. Repeated rows and ids each get their row, an empty table gives none, and other columns
    are not read. Rows stay where they are. A very long text is aligned alone, in about 200 bytes of memory per byte.
    """
    spark = docs.sparkSession
    a_file, b_file = file_bytes(spark, a_path), file_bytes(spark, b_path)

    def places(runs: Iterator, found: Aligned, names: list[str]) -> pa.ListArray:
        parts = [np.stack(run) for run in runs]
        a, b, value = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        text = found.text_of(a)
        columns = [a - found.a_texts[text], b - found.b_texts[text], value][: len(names)]
        values = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names)
        return _lists(np.searchsorted(text, np.arange(len(found.a_texts))), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_file, b_file, a_path, b_path)
        for batch in batches:
            for first, texts in _groups(batch.column(1).to_pylist()):
                found = aligner.align(texts)
                starts = np.append(found.a_group, found.groups)[found.a_texts[:-1]]
                a_group = found.a_group - np.repeat(starts, np.diff(found.a_texts))
                b_group = found.b_group - np.repeat(starts, np.diff(found.b_texts))
                columns = [
                    batch.column(0).slice(first, len(texts)),
                    _lists(found.a_texts, pa.array(found.a, pa.int32())),
                    _lists(found.b_texts, pa.array(found.b, pa.int32())),
                    _lists(found.a_texts, pa.array(a_group, pa.int32())),
                    _lists(found.b_texts, pa.array(b_group, pa.int32())),
                    places(found.links(), found, ["a", "b", "bytes"]),
                    places(found.shared(), found, ["a", "b"]),
                ]
                names = [id_column, "a_ids", "b_ids", "a_groups", "b_groups", "links", "shared"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, "
        "links array<struct<a:int,b:int,bytes:int>>, shared array<struct<a:int,b:int>>"
    )
    return docs.select(F.col(id_column), text_or_empty(text_column)).mapInArrow(run, schema)


# ---- counts over a corpus


class _Block:
    """Rows whose pairs are listed together; each row names its pairs by their place in the sorted list."""

    def __init__(self, number: int, pair_base: int):
        self.number, self.base, self.size = number, pair_base, 0
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, texts: list[str], found: Aligned) -> None:
        """Count the links of each text by id pair."""
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = len(texts)
        for a, b, _ in found.links():
            # By pair, then text: of one text a run of products holds few different pairs.
            key = (found.a[a] * self.base + found.b[b]) + found.text_of(a) * (self.base << 20)
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
        key, order = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(order, np.concatenate(times), minlength=len(key)).astype(np.int64)
        text, pair = key // (self.base << 20), key % (self.base << 20)
        bounds = np.searchsorted(text, np.arange(width + 1))
        shared = np.concatenate([np.zeros(1, np.int64), np.cumsum(found.shared_counts())])[found.a_texts]
        last = np.append(found.a_group, found.groups)[found.a_texts]
        for k, (row_id, spelled) in enumerate(zip(ids.to_pylist(), found.group_strings())):
            here = slice(bounds[k], bounds[k + 1])
            n_a, n_b = (int(o[k + 1] - o[k]) for o in (found.a_texts, found.b_texts))
            digest = hashlib.sha256(spelled.encode()).hexdigest() if n_a else ""
            sums = (int(last[k + 1] - last[k]), int(n[here].sum()), int(shared[k + 1] - shared[k]))
            self.rows.append((row_id, n_a, n_b, *sums, digest))
            self.keys.append(pair[here])
            self.times.append(n[here])
        self.size += sum(map(len, texts))

    def batches(self, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        pairs, documents = np.unique(np.concatenate(self.keys), return_counts=True)
        nothing = [pa.nulls(1, t) for t in (kind, *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())]
        listed = [_lists(np.array([0, len(v)]), pa.array(v, t)) for v, t in ((pairs, pa.int64()), (documents, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *nothing, *listed], names)
        for first in range(0, len(self.rows), 512):
            rows = list(zip(*self.rows[first : first + 512]))
            keys, times = self.keys[first : first + 512], self.times[first : first + 512]
            # Steps between ascending places are small numbers, which compress well.
            steps = [np.diff(np.searchsorted(pairs, k), prepend=0).astype("<i4").tobytes() for k in keys]
            size = len(keys)
            columns = [
                pa.array([self.number] * size, pa.int64()),
                pa.array(rows[0], kind),
                *[pa.array(r, pa.int64()) for r in rows[1:6]],
                pa.array(rows[6], pa.string()),
                pa.array(steps, pa.binary()),
                pa.array([t.astype("<i4").tobytes() for t in times], pa.binary()),
                *[pa.nulls(size, pa.list_(t)) for t in (pa.int64(), pa.int32())],
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class LinkedCorpus:
    """Alignment of a whole table, with how many documents hold each id pair linked.

    The table is read and encoded once; what is kept of it is written: per row its measures and its different pairs, as
    places in the list of its block. See :func:`align` for the texts and columns it takes.
    """

    def __init__(
        self, docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text"
    ):
        spark = docs.sparkSession
        a_file, b_file = file_bytes(spark, a_path), file_bytes(spark, b_path)
        self.base = base = sentencepiece.SentencePieceProcessor(model_proto=b_file.value).get_piece_size()
        self.id_column = id_column
        kind = docs.schema[id_column].dataType.simpleString()
        measures = ", ".join(f"{m} long" for m in _MEASURES)
        schema = (
            f"block long, `{id_column}` {kind}, {measures}, groups_sha256 string, steps binary, times binary, "
            "pairs array<long>, documents array<int>"
        )
        names = ["block", id_column, *_MEASURES, "groups_sha256", "steps", "times", "pairs", "documents"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = _aligner(a_file, b_file, a_path, b_path)
            block, number, id_type = None, TaskContext.get().partitionId() << 32, None
            for batch in batches:
                id_type = batch.schema.types[0]
                for first, texts in _groups(batch.column(1).to_pylist()):
                    if block is None:
                        block, number = _Block(number, base), number + 1
                    # A run holds fewer than 2**20 texts (a batch does), so text and pair fit one key.
                    block.add(batch.column(0).slice(first, len(texts)), texts, aligner.align(texts))
                    if block.size >= BLOCK_BYTES:
                        yield from block.batches(names, id_type)
                        block = None
            if block:
                yield from block.batches(names, id_type)

        stored = docs.select(F.col(id_column), text_or_empty(text_column)).mapInArrow(run, schema)
        stored = materialize(stored, "aligned")
        self.rows = stored.filter("pairs IS NULL").drop("pairs", "documents")
        listed = stored.filter("pairs IS NOT NULL").select("block", F.arrays_zip("pairs", "documents").alias("all"))
        self._listed = listed.select("block", F.posexplode("all").alias("at", "e")).select(
            "block", "at", F.col("e.pairs").alias("pair"), F.col("e.documents").alias("documents")
        )
        self._blocks = listed
        counted = materialize(self._listed.groupBy("pair").agg(F.sum("documents").alias("documents")), "pair-counts")
        # One row per id of A: no more than its vocabulary.
        a = F.floor(F.col("pair") / base)
        highest = counted.groupBy(a.alias("a")).agg(F.max("documents").alias("highest"))
        counted = counted.withColumn("a", a).join(F.broadcast(highest), "a")
        self._counts = counted.select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))

    def counts(self) -> DataFrame:
        """``(a_id, b_id, documents, best)`` per linked pair of ids; ``best`` if no other pair of that ``a_id`` has more."""
        a, b = F.floor(F.col("pair") / self.base), F.col("pair") % self.base
        return self._counts.select(a.cast("int").alias("a_id"), b.cast("int").alias("b_id"), "documents", "best")

    def scores(self) -> DataFrame:
        """Per row its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_shared`` (links by group), ``groups_sha256``,
        ``n_best`` (links whose pair is the best of its ``a_id``) and ``count_sum`` (the documents of its links' pairs)."""
        id_column = self.id_column
        back = self._listed.select("block", "at", "pair").join(self._counts, "pair")
        back = back.select(F.col("block").alias("home"), "at", "documents", F.col("best").cast("int").alias("best"))
        kind = self.rows.schema[id_column].dataType.simpleString()
        measures = ", ".join(f"{m} long" for m in _MEASURES)
        schema = f"`{id_column}` {kind}, {measures}, groups_sha256 string, n_best long, count_sum long"
        kept = [id_column, *_MEASURES, "groups_sha256"]

        def add_up(rows: pa.Table, pairs: pa.Table) -> pa.Table:
            at, documents, best = (pairs.column(c).to_numpy() for c in ("at", "documents", "best"))
            weight, top = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            weight[at], top[at] = documents, best
            n_best, count_sum = [], []
            for steps, times in zip(rows.column("steps").to_pylist(), rows.column("times").to_pylist()):
                place, n = np.cumsum(np.frombuffer(steps, "<i4")), np.frombuffer(times, "<i4").astype(np.int64)
                n_best.append(int((n * top[place]).sum()))
                count_sum.append(int((n * weight[place]).sum()))
            columns = [*rows.select(kept).columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
            return pa.table(columns, [*kept, "n_best", "count_sum"])

        # A block is the unit of work: partitions grow in number with them, not in size.
        spark = self.rows.sparkSession
        blocks = self._blocks.count()
        parts = min(max(1, blocks), max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4))
        rows, back = self.rows.repartition(parts, "block"), back.repartition(parts, "home")
        return rows.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(add_up, schema)
