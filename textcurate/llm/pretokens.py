"""Byte-level BPE over chunks: what a text's chunk contributes is looked up, and worked out once per chunk.

A chunk is a run of white space with the run of other characters behind it. No pre-token of a byte-level tokenizer
crosses from other characters into white space, and none looks beyond its chunk, so a text is the sum of its chunks.
Inside a new chunk, pre-tokens that are known to encode alone as one token are taken as they are; only the rest is merged.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = regex.compile(_SPLIT)
# The same split, in the form that the merging library finds fastest: no run is given back once it is read.
_FAST_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_CHUNKS = regex.compile(r"\s*\S+|\s+")
# Libraries may know different Unicode versions. Up to here no code point is unassigned in a version that matters.
_LAST_SURE = "՗"
_BEYOND_SURE = regex.compile(f"[^\0-{_LAST_SURE}]")
# The merging library gives up on runs of white space of some hundred thousand characters.
_LONG_SPACE = 50_000
_LONG_SPACES = regex.compile(rf"\s{{{_LONG_SPACE}}}")
# Chunks remembered per Python worker and kind; a full table is emptied, which costs time and no results.
MAX_CHUNKS = 400_000


def byte_alphabet() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelling = {b: chr(b) for b in plain}
    for b in range(256):
        spelling.setdefault(b, chr(0x100 + len(spelling) - len(plain)))
    return spelling


def load(json_bytes: bytes) -> Tokenizer:
    tokenizer = Tokenizer.from_str(json_bytes.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and are proved, by merging them, to encode as one token: string to id."""
    to_byte = {c: b for b, c in byte_alphabet().items()}
    found = {}
    for spelled, token_id in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(to_byte[c] for c in spelled).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if PATTERN.findall(text) == [text] and [t.id for t in tokenizer.model.tokenize(spelled)] == [token_id]:
            found[text] = token_id
    return found


def rank_merger(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """The same merges by rank of the merged string, which a faster library does; None unless proved to be the same.

    Both libraries merge the leftmost pair of lowest rank, one among listed pairs, the other among pairs whose string
    is a token. They part ways only where two neighbours x, y form a token T that is listed with another split. Nothing
    has crossed T's ends by then, so T alone would end as x, y as well: no such T exists if each token, alone, is merged
    into itself. Ids must also be ranks, that is, listed in the order of the merges.
    """
    to_byte = {c: b for b, c in byte_alphabet().items()}
    vocab, merges = tokenizer.get_vocab(with_added_tokens=False), json.loads(tokenizer.model.__getstate__())["merges"]
    joined = ["".join(pair) if isinstance(pair, list) else pair.replace(" ", "") for pair in merges]
    ids = {vocab.get(j) for j in joined}
    made = sorted(i for i in ids if i is not None)
    if [vocab.get(j) for j in joined] != made or len(made) != len(joined):
        return None
    ranks = {}
    for spelled, token_id in vocab.items():
        alone = [t.id for t in tokenizer.model.tokenize(spelled)] == [token_id]
        if token_id in ids and not alone or len(spelled) == 1 and token_id > made[0]:
            return None
        if token_id in ids or len(spelled) == 1:
            ranks[bytes(to_byte[c] for c in spelled)] = token_id
    return tiktoken.Encoding("ranks", pat_str=_FAST_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Odd(Exception):
    """A text that cannot be cut at its spaces alone."""


class _Table(dict):
    def __init__(self, work: Callable, prefix: str, strict: bool):
        self.work, self.prefix, self.strict = work, prefix, strict

    def __missing__(self, piece: str):
        if self.strict and (not piece or piece[-1].isspace()):
            raise Odd
        if len(self) >= MAX_CHUNKS:
            self.clear()
        value = self.work(self.prefix + piece)
        if len(piece) <= 64:
            self[piece] = value
        return value


class ChunkCoder:
    """Token ids or token counts of texts, equal to those of the tokenizer."""

    def __init__(self, json_bytes: bytes, whole: dict[str, int]):
        self.tokenizer, self.whole = load(json_bytes), whole
        alphabet = byte_alphabet()
        self.spell = [alphabet[b] for b in range(256)]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.merger = rank_merger(self.tokenizer)
        self.counts = self._tables(lambda chunk: len(self.ids(chunk, True)))
        self.packed = self._tables(lambda chunk: self.pack(self.ids(chunk, False)))

    @staticmethod
    def _tables(work: Callable) -> tuple[_Table, _Table]:
        return _Table(work, "", False), _Table(work, " ", True)

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.width}", *ids)

    def _merge(self, token: str) -> list[int]:
        if self.merger:
            return self.merger.encode_ordinary(token)
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.spell[b] for b in token.encode()]))]

    def _unsure(self, chunk: str) -> bool:
        if not chunk.isascii() and _BEYOND_SURE.search(chunk):
            return True
        if len(chunk) > _LONG_SPACE and _LONG_SPACES.search(chunk):
            return True
        for special in self.special:
            if special in chunk:
                return True
        return False

    def ids(self, chunk: str, shortcut: bool) -> list[int]:
        if self._unsure(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if self.merger and not shortcut:
            return self.merger.encode_ordinary(chunk)
        ids, whole = [], self.whole
        for token in PATTERN.findall(chunk):
            alone = whole.get(token)
            if alone is None:
                ids += self._merge(token)
            else:
                ids.append(alone)
        return ids

    @staticmethod
    def _looked_up(text: str, tables: tuple[_Table, _Table]):
        plain, spaced = tables
        first, *rest = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Odd
            return plain[first], list(map(spaced.__getitem__, rest))
        except Odd:
            chunks = _CHUNKS.findall(text)
            return plain[chunks[0]], list(map(plain.__getitem__, chunks[1:]))

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, rest = self._looked_up(text, self.counts)
        return first + sum(rest)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian integers of the narrowest width that holds the vocabulary."""
        if not text:
            return b""
        if self.merger and not self._unsure(text):
            # Merging a whole text takes less time than looking up its chunks.
            return np.array(self.merger.encode_ordinary(text), f"<u{struct.calcsize('<' + self.width)}").tobytes()
        first, rest = self._looked_up(text, self.packed)
        return first + b"".join(rest)
