"""Language identification by unigram piece models, summed over all segmentations.

The vocabulary is that of a public SentencePiece model and is the same for all languages; each language has its own piece
probabilities, learned by expectation maximisation. A text is read as lower-case words of letters. The probability
of a word is the sum over all its segmentations into pieces, which a forward pass finds; that of a text is the product
over its words. Words are scored once per Python worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcurate.llm.support import file_bytes, once, text_or_empty
from textcurate.plans.scratch import materialize

MARK, UNKNOWN = "▁", "und"
# Probabilities are multiplied by this per character, to stay near one: each segmentation has the same characters.
_GAIN = 32.0
_FLOOR = 1e-150
# Words remembered per Python worker; a full table is emptied, which costs time and no results.
MAX_WORDS = 250_000
_LONG = 48


def words_of(column: str) -> Column:
    """Lower-case words of letters, separated by spaces."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(column)), r"[^\p{L}]+", " "))


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2


class Lattice:
    """Which pieces of the vocabulary occur where in a word."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = {own.id_to_piece(i).lower() for i in range(own.get_piece_size()) if not own.is_byte(i)}
        self.pieces = sorted(p for p in pieces if p != MARK and p.lstrip(MARK).isalpha() and MARK not in p[1:])
        self.longest = max(map(len, self.pieces))
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, len(piece) << 32 | i)
        self.automaton.make_automaton()
        self.size = len(self.pieces) + 1  # the last stands for any character that is no piece

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``(word, start, end, piece)`` of all occurrences, by end, then word.

        A character that is no piece alone is an arc as well. All words are read in one pass: a piece has a mark at its
        first place at most, so that none reaches into the word before.
        """
        spelled = MARK + MARK.join(words)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(spelled)), np.int64).reshape(-1, 2)
        ends, lengths, pieces = found[:, 0], found[:, 1] >> 32, found[:, 1] & 0xFFFFFFFF
        lacking = np.ones(len(spelled), bool)
        lacking[ends[lengths == 1]] = False
        lone = np.flatnonzero(lacking)
        ends = np.concatenate([ends, lone])
        lengths = np.concatenate([lengths, np.ones(len(lone), np.int64)])
        pieces = np.concatenate([pieces, np.full(len(lone), self.size - 1)])
        first = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        owner = np.searchsorted(first, ends, side="right") - 1
        end = ends - first[owner] + 1
        order = np.lexsort((owner, end))
        owner, end, lengths, pieces = owner[order], end[order], lengths[order], pieces[order]
        return owner, end - lengths, end, pieces


def forward(words: list[str], arcs: tuple[np.ndarray, ...], probabilities: np.ndarray, longest: int):
    """``alpha`` (word, place, language) up to scaling, and log-probabilities (word, language)."""
    owner, start, end, piece = arcs
    sizes = np.array([len(w) + 1 for w in words])
    most, languages = int(sizes.max()), probabilities.shape[1]
    weight = probabilities[piece] * (_GAIN ** (end - start))[:, None]
    alpha = np.zeros((len(words), most + 1, languages))
    alpha[:, 0] = 1.0
    scaled = np.zeros(len(words))
    first = np.searchsorted(end, np.arange(1, most + 2))
    for place in range(1, most + 1):
        own = slice(first[place - 1], first[place])
        owners = owner[own]
        heads = np.flatnonzero(np.diff(owners, prepend=-1))
        alpha[owners[heads], place] = np.add.reduceat(alpha[owners, start[own]] * weight[own], heads, axis=0)
        low = np.flatnonzero((alpha[:, place].max(axis=1) < _FLOOR) & (sizes >= place))
        if len(low):
            alpha[low, max(0, place - longest) : place + 1] *= 1 / _FLOOR
            scaled[low] += np.log(_FLOOR)
    last = np.maximum(alpha[np.arange(len(words)), sizes], 1e-300)
    return alpha, np.log(last) + (scaled - sizes * np.log(_GAIN))[:, None]


def expected_counts(words: list[str], times: np.ndarray, lattice: Lattice, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in ``words`` (of at most ``_LONG`` letters) under one language."""
    arcs = lattice.arcs(words)
    owner, start, end, piece = arcs
    alpha, _ = forward(words, arcs, probabilities[:, None], lattice.longest)
    alpha = alpha[:, :, 0]
    sizes = np.array([len(w) + 1 for w in words])
    weight = probabilities[piece] * _GAIN ** (end - start)
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), sizes] = 1.0
    order = np.argsort(-start, kind="stable")
    cuts = np.searchsorted(-start[order], -np.arange(int(sizes.max()), -1, -1), side="right")
    before = 0
    for stop in cuts:
        own = order[before:stop]
        np.add.at(beta, (owner[own], start[own]), beta[owner[own], end[own]] * weight[own])
        before = stop
    total = np.maximum(alpha[np.arange(len(words)), sizes], 1e-300)
    used = alpha[owner, start] * weight * beta[owner, end] / total[owner] * times[owner]
    return np.bincount(piece, used, minlength=lattice.size)


@dataclass(frozen=True)
class LanguageModel:
    """Piece probabilities, one column per language (in alphabetical order); vocabulary times languages in size."""

    languages: list[str]
    content: Broadcast
    probabilities: Broadcast


def train(
    labelled: DataFrame,
    vocabulary_path: str,
    max_docs: int = 500,
    rounds: int = 2,
    smoothing: float = 0.1,
    text_column: str = "text",
    language_column: str = "lang",
) -> LanguageModel:
    """Learn from about ``max_docs`` different whole texts of each language at most, chosen by a hash of the text.

    Rows without a language or text are left out; copies of a text count once, whatever their ids. Runs of more than 48
    letters, as in scripts without spaces, are learned from in pieces of 48. Without any row the model has no language
    and predicts ``und``.
    """
    spark = labelled.sparkSession
    content = file_bytes(spark, vocabulary_path)
    rows = labelled.filter(F.col(language_column).isNotNull() & F.col(text_column).isNotNull())
    counts = rows.groupBy(F.col(language_column).alias("language")).count().orderBy("language").collect()
    languages = [r["language"] for r in counts]
    lattice = Lattice(content.value)
    if not languages:
        return LanguageModel([], content, spark.sparkContext.broadcast(np.zeros((lattice.size, 0))))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["language"], min(1.0, max_docs / r["count"]))])
    chosen = F.pmod(F.xxhash64(F.lit("language sample"), F.col("text")), F.lit(1_000_003)) / 1_000_003
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    texts = rows.select(F.col(language_column).alias("lang"), F.col(text_column).cast("string").alias("text"))
    texts = texts.filter(chosen < share[F.col("lang")]).distinct()
    word = F.col("word")
    pieces = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{_LONG}}}"), F.lit(0))
    words = (
        texts.select(number[F.col("lang")].alias("language"), F.explode(F.split(words_of("text"), " ")).alias("word"))
        .filter(word != "")
        .select("language", F.explode(F.when(F.length(word) > _LONG, pieces).otherwise(F.array(word))).alias("word"))
    )
    words = materialize(words.groupBy("language", "word").count(), "language-words")
    probabilities = np.full((lattice.size, len(languages)), 1.0 / lattice.size)
    for _ in range(rounds):
        used = _expect(words, vocabulary_path, content, spark.sparkContext.broadcast(probabilities)) + smoothing
        # A character that is no piece is as likely in one language as in another.
        used[-1] = smoothing * used.sum(axis=0) / used.sum(axis=0).max()
        probabilities = used / used.sum(axis=0)
    return LanguageModel(languages, content, spark.sparkContext.broadcast(probabilities))


def _expect(words: DataFrame, path: str, content: Broadcast, shared: Broadcast) -> np.ndarray:
    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = once(("lattice", path), lambda: Lattice(content.value))
        total = np.zeros(shared.value.shape)
        for batch in batches:
            for language, own in batch.groupby("language"):
                texts, times = own["word"].tolist(), own["count"].to_numpy()
                for at in range(0, len(texts), 4096):
                    part, n = texts[at : at + 4096], times[at : at + 4096]
                    total[:, language] += expected_counts(part, n, lattice, shared.value[:, language])
        piece, language = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "language": language, "used": total[piece, language]})

    found = words.mapInPandas(expect, "piece int, language int, used double").groupBy("piece", "language").sum("used")
    used = np.zeros(shared.value.shape)
    for piece, language, n in found.collect():  # at most one row per piece and language
        used[piece, language] = n
    return used


class WordScores(dict):
    """Word to the row of ``table`` that holds its log-probabilities; new words wait until ``settle``."""

    def __init__(self, content: bytes, probabilities: np.ndarray):
        self.lattice, self.probabilities = Lattice(content), probabilities
        self.table, self.waiting = np.empty((1 << 16, probabilities.shape[1])), []
        self.settled = 0

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.waiting.append(word)
        return place

    def settle(self) -> np.ndarray:
        while len(self.table) < len(self):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        short = sorted(range(len(self.waiting)), key=lambda k: len(self.waiting[k]))
        at = 0
        while at < len(short):
            size = len(self.waiting[short[at]])
            step = 4096 if size <= _LONG else 1
            group = short[at : at + step]
            if step > 1:
                group = [k for k in group if len(self.waiting[k]) <= _LONG]
            words = [self.waiting[k] for k in group]
            arcs = self.lattice.arcs(words)
            self.table[self.settled + np.array(group)] = forward(words, arcs, self.probabilities, self.lattice.longest)[1]
            at += len(group)
        self.settled += len(self.waiting)
        self.waiting = []
        return self.table

    def text_scores(self, texts: list[str]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
            self.settled = 0
            self.table = self.table[: 1 << 16]
        rows = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in map(str.split, texts)]
        table = self.settle()
        return np.array([table[r].sum(axis=0) for r in rows])


def predict(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, lang_pred, score)`` per row: the language under which the whole text is most likely, and its posterior.

    All languages count as equally likely beforehand; ties go to the first in the alphabet. A text that is null or has
    no letter is ``und`` with score 0. Repeated rows and ids each get their row; no other column is read, so that
    columns of any name may be there. Rows stay where they are.
    """
    languages, content, shared = model.languages, model.content, model.probabilities
    key = ("word-scores", uuid.uuid4().hex)

    @F.pandas_udf("lang_pred string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = once(key, lambda: WordScores(content.value, shared.value))
        for texts in batches:
            names, posteriors = [], []
            texts = texts.tolist()
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                totals = scores.text_scores(part)
                best = totals.argmax(axis=1)
                top = totals[np.arange(len(part)), best]
                share = 1 / np.exp(totals - top[:, None]).sum(axis=1)
                names += [languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), part)]
                posteriors += [s if t else 0.0 for s, t in zip(share.tolist(), part)]
            yield pd.DataFrame({"lang_pred": names, "score": posteriors})

    if not languages:
        return docs.select(F.col(id_column), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.select(F.col(id_column), classify(words_of(text_column)).alias("_found")).select(
        id_column, "_found.lang_pred", "_found.score"
    )
