"""Best segmentation of text into the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces is run over a chunk once. At each position its output links give the pieces
that end there, longest first, and each relaxes the best score of that position. A chunk is a run of word marks with
the run of other characters behind it; no piece crosses into the next chunk (this is checked when the model is loaded),
so the best segmentation of a text is that of its chunks, which are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.llm.support import file_bytes, once, text_or_empty

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Chunks remembered per Python worker; a full table is emptied, which costs time and no results.
MAX_CHUNKS = 300_000


class PieceCoder(dict):
    """Chunk, without the single mark in front of it, to its ids as bytes."""

    def __init__(self, model: bytes):
        self.own = own = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = own.get_piece_size()
        self.pieces = [own.id_to_piece(i) for i in range(size)]
        self.unknown, self.bytes = own.unk_id(), [-1] * 256
        self.content = [p.replace(MARK, " ").encode() for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        lowest = 0.0
        for i, piece in enumerate(self.pieces):
            if own.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.content[i] = bytes([int(piece[3:-1], 16)])
            elif own.is_control(i) or own.is_unknown(i):
                self.content[i] = b""
            elif not own.is_unused(i):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} would cross chunks")
                lowest = min(lowest, own.get_score(i))
                self.automaton.add_word(piece, (len(piece), i, own.get_score(i)))
        self.automaton.make_automaton()
        # A character without a piece costs ten more than the worst piece, and is spelled in bytes where it can be.
        self.unknown_score = lowest - 10.0
        self.spelled = min(self.bytes) >= 0
        self.scores = np.array([own.get_score(i) for i in range(size)])
        self.scores[self.unknown] = self.unknown_score
        for byte, i in enumerate(self.bytes):
            if i >= 0:  # the first byte of a character stands for all of them
                self.scores[i] = 0.0 if 0x80 <= byte < 0xC0 else self.unknown_score
        every = "".join(map(chr, [*range(0x21, 0x2581), *range(0x2582, 0xD800), *range(0xE000, 0xFFFE)]))
        self.plain = own.normalize(f"{every} \t{every}") == f"{MARK}{every}{MARK}\t{every}"

    def best(self, chunk: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation; among equal ones the longest last piece wins, from the end on."""
        n = len(chunk)
        ending: list[list] = [[] for _ in range(n + 1)]
        for end, output in self.automaton.iter(chunk):
            ending[end + 1].append(output)
        score, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for end in range(1, n + 1):
            top, length, token = None, 1, -1
            for size, i, own in ending[end]:
                total = score[end - size] + own
                if top is None or total > top:
                    top, length, token = total, size, i
            if not ending[end] or ending[end][-1][0] > 1:  # the character alone is no piece
                total = score[end - 1] + self.unknown_score
                if top is None or total > top:
                    top, length, token = total, 1, -1
            score[end], back[end] = top, (length, token)
        ids: list[int] = []
        at = n
        while at:
            length, token = back[at]
            if token >= 0:
                ids.append(token)
            elif self.spelled:
                ids += [self.bytes[b] for b in reversed(chunk[at - 1].encode())]
            else:
                ids.append(self.unknown)
            at -= length
        return ids[::-1], score[n]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_CHUNKS:
            self.clear()
        value = np.array(self.best(MARK + word)[0], "<u4").tobytes()
        if len(word) <= 64:
            self[word] = value
        return value

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers of a whole text, in the model's own normal form."""
        if self.plain and text and "  " not in text and text[0] != " " != text[-1] and MARK not in text:
            return b"".join(map(self.__getitem__, text.split(" ")))
        chunks = _CHUNKS.findall(self.own.normalize(text))
        single = [c[0] == MARK and c[1:2] != MARK and len(c) > 1 for c in chunks]
        found = [self[c[1:]] if one else np.array(self.best(c)[0], "<u4").tobytes() for c, one in zip(chunks, single)]
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, marks as spaces, without the first (added) one."""
        text = b"".join(map(self.content.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _coder(content, path: str) -> PieceCoder:
    return once(("piece-coder", path), lambda: PieceCoder(content.value))


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_pieces, ids array<int>, score)`` per row: the segmentation of the whole text with the best total score.

    Scores are those of the model file, added in double precision. Characters that are no piece are spelled in byte
    pieces, or become the unknown id where the model has none. A null text is an empty one: no ids, score 0. Repeated
    rows and ids each get their row; other columns are not read. Rows stay where they are.
    """
    content = file_bytes(docs.sparkSession, model_path)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content, model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [coder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(ids) // 4 for ids in found)])
                values = np.frombuffer(b"".join(found), "<i4")
                columns = [
                    part.column(0),
                    pa.array(np.diff(ends), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                    pa.array([float(coder.scores[np.frombuffer(ids, "<i4")].sum()) for ids in found], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [id_column, "n_pieces", "ids", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_pieces int, ids array<int>, score double"
    return docs.select(F.col(id_column), text_or_empty(text_column).alias("text")).mapInArrow(segment, schema)


def decode(encoded: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(id, text)``: what the ids spell. Equals the text that was encoded, but for word marks in it, which become spaces."""
    content = file_bytes(encoded.sparkSession, model_path)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(content, model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                offsets, values = part.column(1).offsets.to_numpy().tolist(), part.column(1).values.to_numpy()
                texts = [coder.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, F.coalesce(F.col(ids_column).cast("array<int>"), F.array().cast("array<int>")).alias("ids")).mapInArrow(
        spell, f"`{id_column}` {kind}, text string"
    )
