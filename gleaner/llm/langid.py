"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier on hashed letter
1- to 3-grams predicts each bit. Decoding sums the weighted logistic losses between the
predicted margins and each codeword and takes the least; a small lead is flagged as ambiguous.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import learn
from gleaner.llm.common import in_fold

BITS = 14
HELD_OUT = (4, 2)
# At most so many rows of a language are learned from, and learn.TRAIN_ROWS in all, languages in turn.
ROWS_PER_LANGUAGE = 1500
# A language's rows are numbered in so many parts first.
PARTS = 256
AMBIGUOUS = 0.2
# Characters hashed at once; bounds a task's memory on very long texts.
CHUNK = 1_000_000
_NO_LETTER = regex.compile(r"\P{L}+")

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def letters_of(text: str | None) -> str:
    """Lower-cased words of letters only, one blank around each; empty without a letter."""
    words = _NO_LETTER.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words else ""


def gram_counts(letters: str) -> np.ndarray:
    """Counts of hashed letter 1- to 3-grams over the whole text, 2^BITS of them."""
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for start in range(0, len(letters), CHUNK):
        c = np.frombuffer(letters[start : start + CHUNK + 2].encode("utf-32-le"), dtype=np.uint32)
        whole = min(CHUNK, len(letters) - start)
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + c[1:] + np.uint32(1)
        three = two[:-1] * np.uint32(131) + c[2:] + np.uint32(2) if len(c) > 2 else two[:0]
        for grams in (one, two, three):
            counts += np.bincount(learn.mix(grams[:whole], BITS), minlength=1 << BITS)
    return counts


def _features(letters: str) -> tuple[np.ndarray, np.ndarray]:
    counts = gram_counts(letters)
    ids = np.flatnonzero(counts)
    values = np.sqrt(counts[ids])
    return ids, values / np.sqrt((values**2).sum()) * 4.0


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all non-trivial splits of up to 6 classes, else about
    10 log2(n) random ones that differ between any two classes."""
    if n <= 6:
        splits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(max(1, 2 ** (n - 1) - 1))]
        return np.array(splits, dtype=np.float64).T
    rng = np.random.default_rng(11)
    while True:
        code = rng.choice([-1.0, 1.0], size=(n, math.ceil(10 * math.log2(n))))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code


def _fitted(rows: pd.DataFrame) -> bytes:
    languages = sorted(rows["lang"].unique())
    code = codewords(len(languages))
    known = {lang: i for i, lang in enumerate(languages)}
    made = [_features(x) for x in (letters_of(t) for t in rows["text"]) if x]
    kinds = np.array([known[lang] for t, lang in zip(rows["text"], rows["lang"]) if letters_of(t)], dtype=np.int64)
    weights = learn.fit(made, (code[kinds] + 1) / 2, 1 << BITS, l1=0.05)
    # How often each bit is right for each language; the weights of a codeword's losses sum to one.
    margins = np.array([values @ weights[ids] for ids, values in made])
    right = np.array([((margins[kinds == k] * code[k]) > 0).mean(axis=0) if (kinds == k).any() else np.ones(code.shape[1]) for k in range(len(code))])
    right = np.maximum(right, 1e-3)
    return pickle.dumps((languages, code, right / right.sum(axis=1, keepdims=True), weights))


def decode(margins: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Probabilities of the classes: softmax of the negative weighted losses."""
    losses = (trust * np.logaddexp(0.0, -code * margins[None, :])).sum(axis=1) * code.shape[1]
    likely = np.exp(losses.min() - losses)
    return likely / likely.sum()


def sample(documents: DataFrame) -> DataFrame:
    """(lang, text) of the documents to learn from: languages in turn, each by hash. Repeated rows count once, and a doc_id
    with several texts in a language gives one of them. Beyond learn.TRAIN_ROWS languages some are not learned."""
    learnable = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    usable = documents.where(learnable & ~in_fold(F.col("doc_id"), *HELD_OUT))
    order = F.xxhash64("doc_id")
    # The first of a language are among the first of its parts, so no task sees a whole language.
    known = usable.select("doc_id", "lang").distinct().withColumn("_part", F.pmod(order, F.lit(PARTS)))
    within = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(order, "doc_id"))
    some = known.withColumn("turn", within).where(F.col("turn") <= ROWS_PER_LANGUAGE)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    some = some.withColumn("turn", turn).where(F.col("turn") <= ROWS_PER_LANGUAGE)
    some = some.orderBy("turn", order, "doc_id").limit(learn.TRAIN_ROWS).select("doc_id", "lang")
    # At most learn.TRAIN_ROWS rows: a broadcast of proven size.
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(some), ["doc_id", "lang"])
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    return texts.groupBy("doc_id", "lang").agg(one.alias("text")).select("lang", "text")


FOUND = "lang_pred string, score double, ambiguous boolean"


def language(documents: DataFrame) -> Column:
    """A struct column for `text`: lang_pred, score (probability of that language), and
    ambiguous (its lead over the next is under AMBIGUOUS).

    `und`, 0.0 and true for NULL texts, texts without a letter, or when nothing could be
    learned. Learns from text and lang of a bounded sample of rows outside the held-out fold.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn.train(sample(documents), _fitted))

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(shared.value) if shared.value else None
        for texts in batches:
            out = []
            for text in texts:
                letters = letters_of(text)
                if not letters or model is None:
                    out.append(("und", 0.0, True))
                    continue
                languages, code, trust, weights = model
                ids, values = _features(letters)
                likely = decode(values @ weights[ids], code, trust)
                best = int(likely.argmax())
                rest = np.delete(likely, best).max(initial=0.0)
                out.append((languages[best], float(likely[best]), bool(likely[best] - rest < AMBIGUOUS)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    return F.pandas_udf(predict, FOUND)("text")


def op8_language(documents: DataFrame) -> DataFrame:
    found = documents.select("doc_id", "text").withColumn("_found", language(documents))
    return found.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), "_found.*")
