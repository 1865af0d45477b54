"""Word hashes of many texts at once, with numpy and no Python object per word.

A word is a run of ASCII letters and digits and of any characters beyond ASCII. Texts come in lower case.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# Bytes of text at a time; what is made of them on the way takes some fifty times that.
_GROUP_BYTES = 1 << 19

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _IS_WORD[_low : _high + 1] = True

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``n``."""
    if len(_powers[base]) < n:
        factors = np.full(max(n, _GROUP_BYTES + 1), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[str]):
    """Slices of ``texts`` of about half a megabyte, or of one longer text, as ``(first, encoded)``."""
    group, size, first = [], 0, 0
    for k, text in enumerate(texts):
        encoded = text.encode()
        if group and size + len(encoded) > _GROUP_BYTES:
            yield first, group
            group, size, first = [], 0, k
        group.append(encoded)
        size += len(encoded)
    if group:
        yield first, group


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place behind each text's last word: ``(words, ends)``."""
    raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)))])
    words = mix((sums[stops] - sums[starts]) * _power(_INVERSE, len(raw))[starts])
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return words, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, ends: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted set of hashes of its runs of ``n`` words; a shorter text is one run, an empty one has none."""
    runs = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        runs[: len(words) - k] = runs[: len(words) - k] * np.uint64(_BASE) + words[k:]
    runs = mix(runs)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= n:
            out.append(np.unique(runs[start : end - n + 1]))
        elif end > start:
            weights = _power(_BASE, end - start + 1)[1:]
            out.append(mix(np.array([(words[start:end] * weights).sum(dtype=np.uint64)])))
        else:
            out.append(words[:0])
        start = end
    return out
