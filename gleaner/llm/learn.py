"""Hashed sparse features and logistic regression by follow-the-regularised-leader updates.

A model is fitted in one task on a bounded sample of labelled rows and has a fixed
number of weights, so it may pass the driver and be broadcast whatever the corpus.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import in_fold

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A sample of so many labelled rows is learned from, rows of least hash first.
TRAIN_ROWS = 8192
EPOCHS = 4


def mix(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned 32-bit hashes to `bits` well-mixed bits."""
    h = hashes.astype(np.uint32, copy=False)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return ((h ^ (h >> np.uint32(16))) >> np.uint32(32 - bits)).astype(np.int32)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


class Ftrl:
    """FTRL-proximal logistic regression, one column of weights for each binary output."""

    def __init__(self, dims: int, outputs: int = 1, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.z = np.zeros((dims, outputs))
        self.n = np.zeros((dims, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def learn(self, ids: np.ndarray, values: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """One update; ids are distinct."""
        w = self.weights(ids)
        p = 1.0 / (1.0 + np.exp(-np.clip(values @ w, -30, 30)))
        g = values[:, None] * (weight * (p - target))[None, :]
        n = self.n[ids]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[ids] += g - sigma * w
        self.n[ids] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, dims: int, **options) -> np.ndarray:
    """Weights (dims, outputs) after some epochs over (ids, values) rows in a fixed shuffled order."""
    model = Ftrl(dims, targets.shape[1], **options)
    # A rarer class counts more, by the root of how much rarer it is.
    share = np.clip(targets.mean(axis=0), 1e-3, 1 - 1e-3) if len(rows) else 0.5
    weights = np.where(targets > 0.5, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            model.learn(*rows[i], targets[i], weights[i])
    return model.weights(slice(None)).astype(np.float32)


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, divisor: int, fold: int, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, target) of at most `rows` documents with a label 0 or 1, none of the held-out fold."""
    known = labels.where(~in_fold(F.col("doc_id"), divisor, fold) & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
    some = known.select("doc_id", F.col(target).cast("int").alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most so many rows of two numbers: a broadcast of proven size.
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "target")


def train(sample: DataFrame, fitted: Callable[[pd.DataFrame], bytes]) -> bytes:
    """The model that `fitted` makes of the whole bounded sample in one task; b"" of an empty one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fitted(rows)]})

    found = sample.groupBy(F.lit(0).alias("one")).applyInPandas(run, "model binary").first()
    return bytes(found[0]) if found else b""


def scored(text: Column, model: bytes, spark, features: Callable[[str, dict], tuple[np.ndarray, np.ndarray]]) -> Column:
    """The logistic score of every text by sparse dot products; 0.5 where nothing was learned."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.frombuffer(shared.value, dtype=np.float32) if shared.value else None
        cache: dict = {}
        for texts in batches:
            out = np.full(len(texts), 0.5)
            if weights is not None:
                for i, text in enumerate(texts):
                    ids, values = features(text or "", cache)
                    out[i] = 1.0 / (1.0 + np.exp(-np.clip(values @ weights[ids], -30, 30)))
            yield pd.Series(out)

    return F.pandas_udf(score, "double")(text)
