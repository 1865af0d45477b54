"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A template of at most c words (c a power of two) is looked for in blocks of 2c words that begin at every c-th word, so that
a copy lies in one of them whole. A block matches if it holds at least a share ``threshold`` of the template's different
words. Words are ordered by how many documents hold them, rarest first; a block and a template that share enough words
share one within the first few of each, so only those few are joined, and only blocks with such a word are built.
DataFrame functions only; texts are not moved.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcurate.plans.scratch import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
SMALLEST_BLOCK = 8
THRESHOLD = 0.85

# Phrases whose places are reported, by label.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# The notices that licenses ask for, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def words(text: Column) -> Column:
    """The words of a text, with A-Z in lower case and no other letter changed."""
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Template:
    """Different words, the least number of them that counts, and half of the width of the blocks to look in."""

    label: str
    words: frozenset[str]
    need: int
    block: int

    @classmethod
    def of(cls, label: str, text: str, threshold: float) -> Template:
        all_words = plain_words(text)
        if not all_words or not 0 < threshold <= 1:
            raise ValueError(f"a template needs words and a threshold above 0 and up to 1: {label!r}, {threshold}")
        different = frozenset(all_words)
        block = max(SMALLEST_BLOCK, 1 << (len(all_words) - 1).bit_length())
        # Whole numbers need no slack; others are away from the next one by more than rounding.
        return cls(label, different, math.ceil(threshold * len(different) - 1e-9), block)

    def ranked(self, order: dict[str, int]) -> list[int]:
        return sorted(order[w] for w in self.words)

    def prefix(self, order: dict[str, int]) -> list[int]:
        """Of the words in order, any ``need`` hold one of these."""
        return self.ranked(order)[: len(self.words) - self.need + 1]


def _text(docs: DataFrame, text_column: str) -> Column:
    return words(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def word_order(docs: DataFrame, vocabulary: set[str], text_column: str = "text") -> list[str]:
    """``vocabulary`` by the number of documents that hold a word, rarest first. All documents are counted."""
    known = F.array_distinct(F.filter(F.col("words"), lambda w: w.isin(sorted(vocabulary))))
    seen = docs.select(_text(docs, text_column).alias("words")).select(F.explode(known).alias("word"))
    counts = {r[0]: r[1] for r in seen.groupBy("word").count().collect()}  # one row per word of the templates
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _phrase_starts(phrase: str) -> Column:
    """Where the words of a phrase stand one behind the other."""
    parts = phrase.split()
    last = len(parts) - 1

    def ends_here(at: Column) -> Column:
        found = F.get("words", at) == parts[last]
        for back in range(1, last + 1):
            found = found & (F.get("words", at - back) == parts[last - back])
        return found

    return F.transform(F.filter("marks", ends_here), lambda at: at - last)


def _blocks(block: int, tokens: list[str], order: list[str]) -> Column:
    """The blocks of one width that hold any of ``tokens``: which, and their template words as sorted ranks."""
    hits = F.filter("marks", lambda at: F.get("words", at).isin(tokens))
    first = F.transform(hits, lambda at: F.floor(at / block))
    starts = F.filter(F.array_distinct(F.concat(first, F.transform(first, lambda k: k - 1))), lambda k: k >= 0)
    ranks = F.array(*[F.lit(w) for w in order])

    def build(k: Column) -> Column:
        here = F.slice("words", (k * block + 1).cast("int"), F.lit(2 * block))
        known = F.array_distinct(F.filter(here, lambda w: w.isin(order)))
        return F.struct(
            F.lit(block).alias("block"),
            F.array_sort(F.transform(known, lambda w: (F.array_position(ranks, w) - 1).cast("int"))).alias("tokens"),
        )

    return F.transform(starts, build)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row ``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``n_base`` counts the places of all ``PHRASES``; ``first_word`` and ``last_word`` are their smallest and largest start
    (words count from 0), null without any. ``labels`` adds those of templates of which a block holds at least
    ``threshold`` of the different words; ``score`` is the highest such share, 0 without any. Labels are distinct, sorted and
    joined by commas. A null text counts as an empty one: no words. Repeated rows and ids each get their row; an empty
    table gives none; other columns are not read. A text is read twice as a whole, once to order the words of the templates
    and once to find blocks; work and memory grow with its words, up to two blocks a word and width.
    ``templates`` is a parameter of the scan, some hundred texts at most: their words go into the plan.
    """
    known = [Template.of(label, text, threshold) for label, text in templates]
    order = word_order(docs, {w for t in known for w in t.words}, text_column) if known else []
    rank = {w: k for k, w in enumerate(order)}
    prefixes = {
        block: sorted({order[r] for t in known if t.block == block for r in t.prefix(rank)})
        for block in sorted({t.block for t in known})
    }
    marked = sorted({p.split()[-1] for _, p in PHRASES}.union(*prefixes.values()))

    rows = docs.select(F.col(id_column), _text(docs, text_column).alias("words"))
    marks = F.array_compact(F.transform("words", lambda w, at: F.when(w.isin(marked), at)))
    rows = rows.withColumn("marks", marks)
    none = F.array().cast("array<struct<block:int,tokens:array<int>>>")
    blocks = F.concat(none, *[_blocks(block, tokens, order) for block, tokens in prefixes.items()])
    starts = F.struct(*[_phrase_starts(phrase).alias(label) for label, phrase in PHRASES])
    empty = F.size("marks") == 0
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.size("words").cast("long").alias("n_words"),
        F.when(~empty, starts).alias("starts"),
        F.when(~empty, blocks).alias("blocks"),
    )
    rows = materialize(rows, "license-blocks")
    found = _matches(rows, known, rank).groupBy("row").agg(F.collect_set("label").alias("added"), F.max("score").alias("score"))

    places = F.flatten(F.array(*[F.coalesce(F.col("starts")[label], F.array().cast("array<int>")) for label, _ in PHRASES]))
    base = F.array_compact(F.array(*[F.when(F.size(F.col("starts")[label]) > 0, F.lit(label)) for label, _ in PHRASES]))
    no_labels = F.array().cast("array<string>")
    joined = rows.join(found, "row", "left").withColumns({"places": places, "base": base})
    return joined.select(
        F.col("id").alias(id_column),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", no_labels))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _matches(rows: DataFrame, templates: list[Template], rank: dict[str, int]) -> DataFrame:
    """``(row, label, score)`` of every block and template that share enough words."""
    spark = rows.sparkSession
    entries = [
        (t.block, word, at, t.label, t.need, t.ranked(rank)) for t in templates for at, word in enumerate(t.prefix(rank))
    ]
    schema = "block int, token int, at int, label string, need int, template array<int>"
    index = spark.createDataFrame(entries, schema)
    least = {b: min(t.need for t in templates if t.block == b) for b in {t.block for t in templates}}
    block = F.col("block")
    needed = F.coalesce(*[F.when(block == b, F.lit(n)) for b, n in least.items()], F.lit(0))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens")
    size = F.size("tokens")
    # Only the first words of a block can be the first that it shares with a template.
    blocks = blocks.withColumn("needed", needed).filter(size >= F.col("needed"))
    first = F.slice("tokens", F.lit(1), size - F.col("needed") + 1)
    postings = blocks.select("row", "block", "tokens", F.posexplode(first).alias("place", "token"))
    # A few hundred entries, whatever the documents.
    pairs = postings.join(F.broadcast(index), ["block", "token"])
    rest = F.least(F.size("template") - F.col("at"), size - F.col("place"))
    pairs = pairs.filter((size >= F.col("need")) & (rest >= F.col("need")))  # length and position
    earlier = F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("place")), F.slice("template", F.lit(1), F.col("at")))
    shared = F.size(F.array_intersect("tokens", "template"))
    # A pair is taken at the first word it shares, hence once.
    pairs = pairs.filter(~earlier).withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
    return pairs.select("row", "label", (F.col("shared") / F.size("template")).alias("score"))
