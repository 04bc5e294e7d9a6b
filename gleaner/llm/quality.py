"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products."""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import learn
from gleaner.llm.common import in_fold

BITS = 18
THRESHOLD = 0.7
HELD_OUT = (4, 2)
# Words and runs of punctuation are tokens of their own; letter case is kept.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
CACHE_WORDS = 300_000

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def features(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of word 1- and 2-grams, and of repetitions, with L2-normalised log counts, and the bias at id 0."""
    tokens = _TOKEN.findall(text)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    hashes = np.empty(len(tokens), dtype=np.uint32)
    for i, token in enumerate(tokens):
        h = cache.get(token)
        if h is None:
            h = cache[token] = learn.word_hash(token)
        hashes[i] = h
    pairs = hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:]
    # The n-grams `a a` and `a x a` whatever their words, under ids of their own.
    again = [np.full((hashes[lag:] == hashes[:-lag]).sum(), learn.word_hash(f"again {lag}"), dtype=np.uint32) for lag in (1, 2)]
    grams = learn.mix(np.concatenate((hashes, pairs, *again)), BITS)
    ids, counts = np.unique(np.maximum(grams, 1), return_counts=True)
    values = np.log1p(counts)
    norm = np.sqrt((values**2).sum()) or 1.0
    return np.concatenate((np.zeros(1, dtype=np.int32), ids)), np.concatenate(([1.0], values / norm * 3.0)).astype(np.float32)


def _fitted(rows: pd.DataFrame) -> bytes:
    cache: dict[str, int] = {}
    made = [features(text or "", cache) for text in rows["text"]]
    targets = rows["target"].to_numpy(dtype=np.float64)[:, None]
    return learn.fit(made, targets, 1 << BITS, l1=0.1).tobytes()


def quality(documents: DataFrame, labels: DataFrame) -> Column:
    """A column of scores for `text`: 0 to 1, higher for likelier good text.

    NULL and blank texts are scored by the bias alone; without any label all
    scores are 0.5. Learns from at most learn.TRAIN_ROWS labelled rows outside
    the held-out fold; doc_id, lang and source are no inputs.
    """
    sample = learn.labelled_sample(documents, labels, "quality", *HELD_OUT)
    return learn.scored(F.col("text"), learn.train(sample, _fitted), documents.sparkSession, features)


def op2_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scores = documents.select("doc_id", in_fold(F.col("doc_id"), *HELD_OUT).alias("held_out"), quality(documents, labels).alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

