"""Canonical, length-limited Huffman codes over token ids, with numpy over whole arrays."""

from __future__ import annotations

import numpy as np

# Every so many ids of a document the place of the next code is noted; decoding starts at all those places at once.
STRIDE = 256
_SLICE = 1 << 20


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for all symbols with a count (0: no code), by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, levels = np.empty(0), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        merged = both[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    # The cheapest 2n - 2 items of the last level count; a package among them brings two items of the level below.
    taken = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[used[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then symbol, so that the lengths alone are the codebook."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[symbol])
        if bits:
            code <<= bits - last
            codes[symbol], last = code, bits
            code += 1
    return codes


class Encoder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)

    def encode(self, docs: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """For each document its bits, filled up to a byte, and the bit offset of every ``STRIDE``-th id."""
        out, first = [], 0
        while first < len(docs):
            last, size = first, 0
            while last < len(docs) and (last == first or size + len(docs[last]) <= _SLICE):
                size += len(docs[last])
                last += 1
            out += self._encode(docs[first:last])
            first = last
        return out

    def _encode(self, docs: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        ids = np.concatenate(docs)
        if not len(ids):
            return [(b"", b"")] * len(docs)
        sizes = np.array([len(d) for d in docs])
        starts = np.cumsum(sizes) - sizes
        lens = self.lengths[ids].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lens)])
        doc_bits = ends[starts + sizes] - ends[starts]
        doc_bytes = (doc_bits + 7) >> 3
        doc_base = np.cumsum(doc_bytes) - doc_bytes
        at = ends[:-1] + np.repeat(doc_base * 8 - ends[starts], sizes)
        word, shift = at >> 6, 64 - (at & 63) - lens
        codes = self.codes[ids]
        fits = shift >= 0
        high = np.where(fits, codes << np.maximum(shift, 0).astype(np.uint64), codes >> np.maximum(-shift, 0).astype(np.uint64))
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        firsts = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[firsts]] = np.add.reduceat(high, firsts)
        cut = np.flatnonzero(~fits)
        words[word[cut] + 1] += codes[cut] << (64 + shift[cut]).astype(np.uint64)
        bits = words.astype(">u8").tobytes()
        out = []
        for start, size, base, length in zip(starts.tolist(), sizes.tolist(), doc_base.tolist(), doc_bytes.tolist()):
            marks = at[start : start + size : STRIDE] - base * 8
            out.append((bits[base : base + length], marks.astype("<u8").tobytes()))
        return out


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        symbols = np.lexsort((np.arange(len(lengths)), lengths))
        symbols = symbols[lengths[symbols] > 0]
        spans = np.int64(1) << (self.bits - lengths[symbols].astype(np.int64))
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.lengths = np.zeros(1 << self.bits, np.int64)
        filled = int(spans.sum())
        self.symbols[:filled] = np.repeat(symbols, spans)
        self.lengths[:filled] = np.repeat(lengths[symbols], spans)

    def decode(self, payload: bytes, marks: bytes, doc_tokens: np.ndarray) -> np.ndarray:
        """All ids of a block. The codes behind all marks are read side by side, one table look-up per step."""
        doc_tokens = np.asarray(doc_tokens, np.int64)
        lanes = (doc_tokens + STRIDE - 1) // STRIDE
        counts = np.full(int(lanes.sum()), STRIDE, np.int64)
        last = np.cumsum(lanes)[lanes > 0] - 1
        counts[last] = (doc_tokens - (lanes - 1) * STRIDE)[lanes > 0]
        out = np.empty(int(doc_tokens.sum()), np.uint32)
        into = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, into, counts = np.frombuffer(marks, "<u8").astype(np.int64)[order], into[order], counts[order]
        raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        alive = np.searchsorted(-counts, -np.arange(STRIDE), side="left")
        for step in range(int(counts[0]) if len(counts) else 0):
            m = alive[step]
            here = at[:m]
            index = (window[here >> 3] >> (32 - self.bits - (here & 7))) & ((1 << self.bits) - 1)
            out[into[:m] + step] = self.symbols[index]
            here += self.lengths[index]
        return out
