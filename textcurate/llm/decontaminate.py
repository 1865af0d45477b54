"""Benchmark passages in documents, also edited ones, by CGK embedding and bit sampling.

A CGK walk reads a word sequence from a place on: at each step it notes the word under its pointer, and a random bit that
depends on the step and the word decides whether the pointer moves. Sequences within a small edit distance give walks of
small Hamming distance, so a few sampled steps of both agree with fair probability. Walks start at every word of a
document and of an item; windows are as long as the item's length class allows, so that a walk never leaves the item.
Walks are repeated with new bits until the target recall is reached. What agrees is verified by exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcurate.llm.support import forget, text_or_empty
from textcurate.llm.words import grouped, mix, word_hashes

# Least words of an item, steps of its walks, steps that are sampled.
CLASSES = ((20, 12, 5), (10, 8, 4), (5, 4, 3), (4, 4, 4), (3, 3, 3), (2, 2, 2), (1, 1, 1))
# Samples drawn from each walk.
SAMPLES = 4
_FILTER_BITS = 22
# No target needs so many walks unless it cannot be reached.
MOST_WALKS = 512
# Places of a text that one row of the verification covers, and cells of all its rows together.
_SPAN, _CELLS = 4096, 1 << 20
# Buckets of words per item, to tell quickly how many words of a text an item has.
_BUCKETS = 1024
# Benchmarks are sent to the executors in parts of about this size, one pass over the documents for each.
PART_BYTES = 16 << 20
_FOUND = "array<struct<item:long,words:int,distance:int,end_word:int>>"


@dataclass(frozen=True)
class Walk:
    """Random choices of one walk: odd factors that give the bits, and which steps each sample takes."""

    factors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def drawn(steps: int, sampled: int, seed: int) -> Walk:
        random = np.random.default_rng([steps, sampled, seed])
        weights = np.zeros((SAMPLES, steps), np.uint64)
        for row in weights:
            row[random.choice(steps, sampled, replace=False)] = random.integers(1, 1 << 62, sampled, dtype=np.uint64)
        factors = random.integers(0, 1 << 62, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return Walk(factors, weights * np.uint64(2) + (weights > 0).astype(np.uint64))

    def keys(self, words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Per sample a hash of the sampled steps of the walks from ``starts``."""
        at, keys = starts.copy(), [np.zeros(len(starts), np.uint64) for _ in range(SAMPLES)]
        for step, factor in enumerate(self.factors):
            here = words[at]
            for key, weights in zip(keys, self.weights):
                if weights[step]:
                    key += here * weights[step]
            at += ((here * factor) >> np.uint64(63)).astype(np.int64)
        return [mix(k) for k in keys]


@lru_cache
def walks_for(least: int, steps: int, sampled: int, recall: float, similarity: float, trials: int = 200) -> int:
    """Walks needed so that random edits of an item of the class's least length are met with probability ``recall``."""
    random = np.random.default_rng(least)
    edits = int((1 - similarity) * least + 1e-9)
    pairs = []
    for _ in range(trials):
        item = random.integers(1, 1 << 62, least, dtype=np.uint64)
        other = item.tolist()
        for _ in range(edits):
            kind, place = random.integers(3), int(random.integers(len(other)))
            if kind == 1 and len(other) > 1:
                del other[place]
            elif kind == 2:
                other.insert(place, int(random.integers(1, 1 << 62)))
            else:
                other[place] = int(random.integers(1, 1 << 62))
        around = random.integers(1, 1 << 62, 2 * steps, dtype=np.uint64)
        pairs.append((item, np.concatenate([around, np.array(other, np.uint64), around + np.uint64(1)])))
    met = np.zeros(trials, bool)
    for n in range(1, MOST_WALKS + 1):
        walk = Walk.drawn(steps, sampled, n - 1)
        for k, (item, text) in enumerate(pairs):
            if not met[k]:
                own = walk.keys(item, np.arange(least - steps + 1))
                found = walk.keys(text, np.arange(len(text) - steps))
                met[k] = any(np.isin(a, b).any() for a, b in zip(own, found))
        if met.mean() >= recall:
            return n
    raise ValueError(f"{MOST_WALKS} walks do not reach a recall of {recall} at a similarity of {similarity}")


def _merged(owner: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, gap: np.ndarray):
    """Intervals of places, those of one owner and item that lie ``gap`` or less apart made one."""
    order = np.lexsort((low, item, owner))
    owner, item, low, high, gap = (x[order] for x in (owner, item, low, high, gap))
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    group = np.cumsum(fresh) << 42
    # Within a group the farthest end so far; every group lies beyond the one before it.
    reached = np.maximum.accumulate(group + high)
    fresh[1:] |= (group + low)[1:] > reached[:-1] + gap[1:]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], item[first], low[first], (reached - group)[last[: len(first)]]


class Index:
    """Keys of all walks over all items of a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float):
        encoded = [text.encode() for _, text in items]
        words, ends = word_hashes(encoded) if encoded else (np.empty(0, np.uint64), np.empty(0, np.int64))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.ids = np.array([k for k, _ in items], np.int64)
        self.sizes = (ends - starts).astype(np.int64)
        self.allowed = np.floor((1 - similarity) * self.sizes + 1e-9).astype(np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.words = np.zeros((len(items), self.longest), np.uint64)
        for row, a, b in zip(self.words, starts, ends):
            row[: b - a] = words[a:b]
        held = (words & np.uint64(_BUCKETS - 1)).astype(np.int64)
        self.holds = np.zeros(len(items) * _BUCKETS, bool)
        self.holds[np.repeat(np.arange(len(items)), self.sizes) * _BUCKETS + held] = True
        self.probes = []
        left = self.sizes > 0
        for least, steps, sampled in CLASSES:
            own = np.flatnonzero(left & (self.sizes >= least))
            left[own] = False
            if not len(own):
                continue
            offsets = [np.arange(self.sizes[i] - steps + 1) for i in own]
            item = np.repeat(own, [len(o) for o in offsets])
            offset = np.concatenate(offsets)
            for seed in range(walks_for(least, steps, sampled, recall, similarity)):
                walk = Walk.drawn(steps, sampled, seed)
                tables = []
                for keys in walk.keys(words, starts[item] + offset):
                    # A key that comes up again within the edits that an item allows leads to the same part of a text.
                    names, which = np.unique(keys, return_inverse=True)
                    which, own_item, low, high = _merged(which, item, offset, offset, np.maximum(1, self.allowed[item]))
                    maybe = np.zeros(1 << _FILTER_BITS, bool)
                    maybe[keys >> np.uint64(64 - _FILTER_BITS)] = True
                    tables.append((names[which], own_item, low, high, maybe))
                self.probes.append((walk, tables))
        self.pad = max(steps for _, steps, _ in CLASSES) + 1

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """Per text the items found in it, each once, at its best (then first) place."""
        out: list[list[dict]] = []
        for _, encoded in grouped(texts):
            out += self._matches(encoded)
        return out

    def _matches(self, encoded: list[bytes]) -> list[list[dict]]:
        words, ends = word_hashes(encoded)
        sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
        firsts = np.cumsum(sizes + self.pad) - sizes  # a text's words stand behind its padding of zeros
        padded = np.zeros(int(sizes.sum()) + self.pad * (len(sizes) + 1), np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.arange(len(words)) + (owner + 1) * self.pad
        padded[starts] = words
        found = [np.empty((4, 0), np.int64)]
        for walk, tables in self.probes:
            for keys, (known, item, low, high, maybe) in zip(walk.keys(padded, starts), tables):
                hits = np.flatnonzero(maybe[keys >> np.uint64(64 - _FILTER_BITS)])
                first = np.searchsorted(known, keys[hits], "left")
                many = np.searchsorted(known, keys[hits], "right") - first
                place = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                begin = np.repeat(starts[hits], many)
                own = np.repeat(owner[hits], many)
                # Neighbouring places of a text are verified together, so a repetitive text has few intervals.
                merged = _merged(own, item[place], begin - high[place], begin - low[place], self.allowed[item[place]] + 1)
                found.append(np.stack(merged))
        own, item, low, high = np.concatenate(found, axis=1)
        own, item, low, high = _merged(own, item, low, high, self.allowed[item] + 1)
        # Long intervals are cut.
        cuts = (high - low) // _SPAN + 1
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        own, item, low, high = (np.repeat(x, cuts) for x in (own, item, low, high))
        low = low + part * _SPAN
        span = np.minimum(high - low, _SPAN - 1)
        width = self.sizes[item] + 2 * self.allowed[item] + span
        order = np.argsort(width, kind="stable")
        own, item, low, span, width = (x[order] for x in (own, item, low, span, width))
        best: list[dict] = [{} for _ in sizes]
        at = 0
        while at < len(item):
            # Rows are as wide as the last of them.
            fits = np.arange(1, min(4096, len(item) - at) + 1) * width[at : at + 4096] <= _CELLS
            stop = at + max(1, int(fits.sum()))
            here = slice(at, stop)
            which, distance, end = self._near(item[here], low[here], span[here], padded, firsts[own[here]], sizes[own[here]])
            for k, d, e in zip(which.tolist(), distance.tolist(), end.tolist()):
                rows, rank = best[own[at + k]], (d, e)
                if rank < rows.get(item[at + k], (1 << 60,)):
                    rows[item[at + k]] = rank
            at = stop
        return [
            [
                {"item": int(self.ids[i]), "words": int(self.sizes[i]), "distance": d, "end_word": e}
                for i, (d, e) in sorted(rows.items())
            ]
            for rows in best
        ]

    def _near(self, item, begin, span, padded, first, length):
        """Candidates within the allowed edits, their least edit distance to a part of the text that begins around ``begin``
        or up to ``span`` words behind it, and the number of words up to the end of the first such part."""
        size, allowed = self.sizes[item], self.allowed[item]
        width = int((size + 2 * allowed + span).max(initial=0))
        places = (begin - allowed)[:, None] + np.arange(width)
        inside = (places >= first[:, None]) & (places < (first + length)[:, None])
        inside &= np.arange(width) < (size + 2 * allowed + span)[:, None]
        region = np.where(inside, padded[np.clip(places, 0, len(padded) - 1)], np.uint64(0))
        # All but ``allowed`` words of the item stand in a part within so many edits. Most candidates fail that.
        buckets = (region & np.uint64(_BUCKETS - 1)).astype(np.int64) + (item * _BUCKETS)[:, None]
        which = np.flatnonzero((self.holds[buckets] & inside).sum(axis=1) >= size - allowed)
        region = region[which]
        steps = np.arange(width + 1, dtype=np.int32)
        row = np.zeros((len(which), width + 1), np.int32)
        found = []
        for i in range(int(size.max(initial=0))):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, :-1] + (region != self.words[item[which], i][:, None]), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            ended = size[which] == i + 1
            if i % 4 == 3 or ended.any():
                least = row.min(axis=1)
                near = least <= allowed[which]  # the least of a row never falls again
                out = np.flatnonzero(ended & near)
                found.append((which[out], least[out], (begin - allowed - first)[which[out]] + row[out].argmin(axis=1)))
                on = np.flatnonzero(near & ~ended)
                which, row, region = which[on], row[on], region[on]
            if not len(which):
                break
        if not found:
            return which[:0], which[:0], which[:0]
        return tuple(np.concatenate(column) for column in zip(*found))


def _parts(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts that fit memory; which part an item is in follows from its id."""
    items = benchmark.select(
        F.col(item_column).cast("long").alias("item"), F.lower(text_or_empty(text_column)).alias("text")
    ).filter("item IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // PART_BYTES)
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else items
        yield sorted({(r["item"], r["text"]) for r in own.collect()})


def found_items(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.95,
    item_column: str = "item_id",
    text_column: str = "text",
) -> Column:
    """A column for ``docs``: the items in its text, ``array<struct<item, words, distance, end_word>>``.

    An item of L words is found where a part of the text is within ``(1 - similarity) * L`` word edits of it. Words are
    compared in lower case, without punctuation. Time is linear in a text's length, also where words repeat: neighbouring
    candidates become one interval, which is verified once. An exact copy is always found; an edited one of the least similarity
    with probability ``recall`` at least, all its edits being random (real ones are mostly fewer).
    """
    found = F.array().cast(_FOUND)
    for items in _parts(benchmark, item_column, text_column):
        look = _looker(docs.sparkSession.sparkContext.broadcast(items), similarity, recall)
        found = F.concat(found, look(F.lower(text_or_empty(text_column))))
    return found


def _looker(shared: Broadcast, similarity: float, recall: float):
    @F.pandas_udf(_FOUND)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        index = Index(shared.value, similarity, recall)
        for texts in batches:
            yield pd.Series(index.matches(texts.tolist()), dtype=object)

    return look


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.95,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, item_id, item_words, distance, similarity, end_word)``: which document holds which item, once per pair.

    ``end_word`` is the number of the text's words up to the end of the best (then first) place. Null or empty texts and
    items hold nothing and are in nothing; items with a null id are left out, and two texts of one item id are two
    items. Repeated rows of documents each get their rows; other columns are not read. Documents stay where they are.
    """
    found = found_items(docs, benchmark, similarity, recall, item_column, text_column)
    rows = docs.select(F.col(id_column), F.explode(found).alias("_f"))
    return rows.select(
        id_column,
        F.col("_f.item").alias(item_column),
        F.col("_f.words").alias("item_words"),
        F.col("_f.distance").alias("distance"),
        (1 - F.col("_f.distance") / F.col("_f.words")).alias("similarity"),
        F.col("_f.end_word").alias("end_word"),
    )
