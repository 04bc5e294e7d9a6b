"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted over the whole corpus. A disguised word (leetspeak,
masked or spaced-out letters, long repetitions) becomes a lattice of what each sign may
stand for, with the channel's costs; Viterbi decoding takes the likeliest path. Words and
word beginnings of the restored text feed a logistic regression trained by FTRL updates.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import groupby
from math import log

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import learn
from gleaner.llm.common import in_fold
from gleaner.llm.langid import CHUNK, letters_of

BITS = 18
THRESHOLD = 0.7
HELD_OUT = (3, 1)
# Insults are rare, so more rows are learned from than elsewhere.
TRAIN_ROWS = 16384
# Hashed trigram and context counts: a fixed size for any number of letters.
TRIGRAM_BITS, CONTEXT_BITS = 18, 14
CACHE_WORDS = 200_000
# A longer run of signs is a key or a link, not a word, and stays as it is.
LONGEST_WORD = 64

# What a sign may stand for in a disguised word, besides itself.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
MASKS = "*#_%"
# Log costs of the channel: a substituted sign, a guessed masked letter, a collapsed repetition, a kept digit.
SUBSTITUTED, GUESSED, COLLAPSED, KEPT = -0.5, -1.0, -0.2, -6.0

# A word within a run of other signs; letters spelled out with signs between.
_WORD = re.compile(r"[@$]?[^\W_](?:[^\W_]|[@$!|+€£(¡*#_%](?=\S*[^\W_]))*")
_SPELLED = re.compile(r"(?:[^\W_]|[@$!])(?:[._\-*]+(?:[^\W_]|[@$!])){2,}")
_SPACED = re.compile("1{3,}")
_DISGUISED = re.compile(r"[\W\d_]|([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _hashed(a, b, c=None):
    """Hash of a context or a trigram of code points (numbers or arrays)."""
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    return two if c is None else two * np.uint32(0xC2B2AE3D) + c


def trigram_counts(documents: DataFrame) -> DataFrame:
    """(kind, bucket, n): counts of hashed letter trigrams and contexts over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(1 << bits, dtype=np.int64) for bits in (TRIGRAM_BITS, CONTEXT_BITS)]
        for rows in batches:
            # Two blanks between words: a word begins in the same context everywhere.
            letters = "".join(map(letters_of, rows["text"])).replace(" ", "  ")
            for start in range(0, len(letters), CHUNK):
                c = np.frombuffer(letters[start : start + CHUNK + 2].encode("utf-32-le"), dtype=np.uint32)
                if len(c) > 2:
                    tables[0] += np.bincount(learn.mix(_hashed(c[:-2], c[1:-1], c[2:]), TRIGRAM_BITS), minlength=1 << TRIGRAM_BITS)
                    tables[1] += np.bincount(learn.mix(_hashed(c[:-2], c[1:-1]), CONTEXT_BITS), minlength=1 << CONTEXT_BITS)
        for kind, table in enumerate(tables):
            used = np.flatnonzero(table)
            yield pd.DataFrame({"kind": kind, "bucket": used, "n": table[used]})

    counted = documents.select("text").mapInPandas(count, "kind int, bucket int, n long")
    return counted.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def language_model(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts as two arrays of fixed length."""
    counts = trigram_counts(documents).toPandas()  # at most 2^TRIGRAM_BITS + 2^CONTEXT_BITS rows
    tables = np.zeros(1 << TRIGRAM_BITS, dtype=np.int64), np.zeros(1 << CONTEXT_BITS, dtype=np.int64)
    for kind, table in enumerate(tables):
        some = counts[counts["kind"] == kind]
        table[some["bucket"].to_numpy()] = some["n"].to_numpy()
    return tables


class Restorer:
    """Viterbi decoding of disguised words under the trigram model."""

    def __init__(self, trigrams: np.ndarray, contexts: np.ndarray):
        self.trigrams, self.contexts = trigrams, contexts
        self.words: dict[str, str] = {}
        self.chances: dict[str, float] = {}

    def chance(self, last: str, sign: str) -> float:
        """log P(sign | last two signs), add-one smoothed over some hundred letters."""
        key = last + sign
        found = self.chances.get(key)
        if found is None:
            a, b, c = (np.array([ord(x)], dtype=np.uint32) for x in key)
            n = self.trigrams[learn.mix(_hashed(a, b, c), TRIGRAM_BITS)[0]]
            of = self.contexts[learn.mix(_hashed(a, b), CONTEXT_BITS)[0]]
            found = self.chances[key] = log((min(n, of) + 0.01) / (of + 1.0))
        return found

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of one sign: what it may stand for, with the channel's log cost."""
        columns = []
        for sign, run in groupby(word):
            n = len(list(run))
            if sign in MASKS:
                columns += [[(x, GUESSED) for x in "abcdefghijklmnopqrstuvwxyz"]] * min(n, 4)
                continue
            stands = [(x, SUBSTITUTED) for x in SIGNS.get(sign, "")]
            stands.append((sign, 0.0 if sign.isalpha() else KEPT))
            times = {1: 0.0} if n == 1 else {1: COLLAPSED, 2: 0.0 if n == 2 else COLLAPSED}
            columns.append([(x * k, cost * k + extra) for x, cost in stands for k, extra in times.items()])
        return columns

    def decode(self, word: str) -> str:
        paths = {"  ": (0.0, "")}
        for column in [*self.lattice(word), [(" ", 0.0)]]:
            found: dict[str, tuple[float, str]] = {}
            for last, (score, text) in paths.items():
                for option, cost in column:
                    total, state = score + cost, last
                    for sign in option:
                        total += self.chance(state, sign)
                        state = state[1] + sign
                    if state not in found or found[state][0] < total:
                        found[state] = (total, text + option)
            paths = found
        return max(paths.values())[1].strip()

    def restore(self, word: str) -> str:
        """The word itself, unless it is disguised."""
        if len(word) > LONGEST_WORD or not _DISGUISED.search(word) or not _LETTER.search(word):
            return word
        if word not in self.words:
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            self.words[word] = self.decode(word)
        return self.words[word]

    def restored(self, token: str) -> list[str]:
        """The words of one token between blanks, restored."""
        if _SPELLED.fullmatch(token):
            return [self.restore(re.sub(r"[._\-*]+", "", token))]
        return [self.restore(word) for word in _WORD.findall(token)]


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a whole text between blanks, lower-cased; three and more single letters in a row also as one."""
    tokens = text.lower().split() if text else []
    single = "".join(["1" if len(token) == 1 else "0" for token in tokens])
    spelled = ("".join(tokens[m.start() : m.end()]) for m in _SPACED.finditer(single))
    return {*tokens, *(word for word in spelled if len(set(word)) > 2)}


class Features:
    """Ids of restored words and of their beginnings of 3 to 6 signs, remembered by token."""

    def __init__(self, restorer: Restorer, weights: np.ndarray | None = None):
        """With weights, only ids that have one are remembered: for scoring, the others are nothing."""
        self.restorer, self.weights = restorer, weights
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        ids: set[int] = set()
        fresh = []
        for token in tokens_of(text):
            found = self.known.get(token)
            if found is None:
                fresh.append(token)
            elif found:
                ids.update(found)
        if fresh:
            ids.update(self._learn(fresh))
        return ids

    def _learn(self, tokens: list[str]) -> list[int]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        hashes, ends = [], []
        for token in tokens:
            for word in self.restorer.restored(token):
                hashes.append(learn.word_hash(f"={word}"))
                hashes += [learn.word_hash(word[:n]) for n in range(3, min(7, len(word) + 1))]
            ends.append(len(hashes))
        ids = np.maximum(learn.mix(np.array(hashes, dtype=np.uint32), BITS), 1)
        if self.weights is not None:
            ids = np.where(self.weights[ids] != 0, ids, 0)
        start, all_ids = 0, ids.tolist()
        for token, end in zip(tokens, ends):
            self.known[token] = tuple(i for i in all_ids[start:end] if i)
            start = end
        return [i for i in all_ids if i]


def _row(ids: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the ids, and the bias at id 0."""
    found = np.fromiter(ids, dtype=np.int32, count=len(ids))
    found.sort()
    return np.concatenate((np.zeros(1, dtype=np.int32), found)), np.ones(len(found) + 1, dtype=np.float32)


def toxicity(documents: DataFrame, labels: DataFrame) -> Column:
    """A column of scores for `text`: 0 to 1, higher for likelier toxic text.

    NULL and blank texts are scored by the bias alone; without any label all scores
    are 0.5. Learns from at most TRAIN_ROWS labelled rows outside the held-out
    fold; the character model counts every text. doc_id, lang and source are no inputs.
    """
    spark = documents.sparkSession
    tables = spark.sparkContext.broadcast(language_model(documents))

    def fitted(rows: pd.DataFrame) -> bytes:
        features = Features(Restorer(*tables.value))
        made = [_row(features.of(text)) for text in rows["text"]]
        targets = rows["target"].to_numpy(dtype=np.float64)[:, None]
        return learn.fit(made, targets, 1 << BITS, alpha=1.0, l1=4.0).tobytes()

    model = spark.sparkContext.broadcast(learn.train(learn.labelled_sample(documents, labels, "toxic", *HELD_OUT, TRAIN_ROWS), fitted))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.frombuffer(model.value, dtype=np.float32) if model.value else None
        features = Features(Restorer(*tables.value), weights)
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if weights is not None:
                for i, text in enumerate(texts):
                    ids, values = _row(features.of(text))
                    out[i] = 1.0 / (1.0 + np.exp(-np.clip(values @ weights[ids], -30, 30)))
            yield pd.Series(out)

    return F.pandas_udf(score, "double")("text")


def op6_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scores = documents.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), toxicity(documents, labels).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
