"""Nearest neighbours over dense vectors.

The corpus is read once per block of questions and never shuffled: every task
holds one bounded block of question vectors, streams its own corpus rows
through numpy, and keeps only the best k per question. No (question, vector)
pair leaves a task but those. Beyond one block the corpus is read again.

Vectors that are NULL, hold a NULL or non-finite number, differ from the
questions in length, or (for cosine) are zero are nobody's neighbour.
The approximate search meets questions and vectors in hash buckets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.search import DIGITS, top_per_key
from gleaner.session import broadcast_if_small, write_table

BLOCK_BYTES = 64 * 1024 * 1024
METRICS = ("l2", "cosine")
FOUND = "q_id long, doc_id long, distance double, rank long"
# Modulus of the rule that makes the hash planes; its cube fits a long.
PRIME = 1_000_003

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _distances(metric: str, vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
    dot = vectors @ asked.T
    if metric == "cosine":
        scale = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(asked, axis=1)[None, :]
        found = 1.0 - np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
    else:
        found = (vectors**2).sum(axis=1)[:, None] + (asked**2).sum(axis=1)[None, :] - 2.0 * dot
        found = np.maximum(found, 0.0)
    return np.round(found, DIGITS) + 0.0


def _keep_best(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, found: np.ndarray, k: int):
    """The k least (distance, id); only rows that can be among them are sorted."""
    limit = np.partition(found, k - 1)[k - 1] if len(found) > k else np.inf
    if best is not None and len(best[0]) == k:
        limit = min(limit, best[1][-1])
    near = found <= limit
    ids, found = ids[near], found[near]
    if best is not None:
        ids, found = np.concatenate([best[0], ids]), np.concatenate([best[1], found])
    order = np.lexsort((ids, found))[:k]
    return ids[order], found[order]


def _usable(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, vector) of the vectors that have distances."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    found = rows.select(key, F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    found = found.where(F.coalesce(finite, F.lit(False)))
    return found.where(F.exists("vector", lambda x: x != 0)) if metric == "cosine" else found


def _search_block(corpus: DataFrame, asked: pd.DataFrame, k: int, metric: str) -> DataFrame:
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((asked["q_id"].to_numpy(), np.stack(asked["vector"].to_numpy())))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_vectors = shared.value
        q_vectors = q_vectors.astype(np.float64)
        best: list = [None] * len(q_ids)
        for batch in batches:
            if batch.empty:
                continue
            ids = batch["doc_id"].to_numpy()
            vectors = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            step = max(1, 4_000_000 // len(ids))
            for start in range(0, len(q_ids), step):
                found = _distances(metric, vectors, q_vectors[start : start + step])
                for column in range(found.shape[1]):
                    at, near = start + column, found[:, column]
                    best[at] = _keep_best(best[at], ids, near, k)
        for q_id, kept in zip(q_ids, best):
            if kept is not None and len(kept[0]):
                yield pd.DataFrame({"q_id": q_id, "doc_id": kept[0], "distance": kept[1]})

    return corpus.mapInPandas(scan, "q_id long, doc_id long, distance double")


def _asked(queries: DataFrame, metric: str) -> tuple[DataFrame, int, int]:
    """The questions as a written table, so that every pass sees the very same vectors; their number and length."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    asked = write_table(_usable(queries, "q_id", metric), "query-vectors")
    shape = asked.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("dim")).first()
    if shape.least != shape.dim:
        raise ValueError("The questions' vectors differ in length.")
    return asked, shape.n, shape.dim or 0


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, *, metric: str = "l2") -> DataFrame:
    """Exact k nearest (q_id, doc_id, distance, rank) of (q_id, vector) in (doc_id, vector).

    `l2` is the squared distance; distances are rounded and equal ones ordered by doc_id.
    """
    asked, n, dim = _asked(queries, metric)
    if not n:
        return corpus.sparkSession.createDataFrame([], FOUND)
    blocks = math.ceil(n * dim * 8 / BLOCK_BYTES)
    # Blocks half full on average, so uneven hashing stays within the bound.
    blocks = 1 if blocks == 1 else 2 * blocks
    rows = _usable(corpus, "doc_id", metric).where(F.size("vector") == dim)
    found = []
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block)
        part = part.toPandas()
        if len(part):
            found.append(_search_block(rows, part, k, metric))
    near = reduce(DataFrame.unionByName, found)
    return top_per_key(near, "q_id", [F.col("distance"), F.col("doc_id")], k)


def planes(dim: int, n: int) -> np.ndarray:
    """(dim, n) whole numbers from -1000 to 1000: the directions of the hash bits, by a fixed rule."""
    x = np.arange(n, dtype=np.int64)[None, :] * 1009 + np.arange(1, dim + 1, dtype=np.int64)[:, None]
    for _ in range(3):
        x = x % PRIME
        x = (x * x * x + 12345 * x + 6789) % PRIME
    return x % 2001 - 1000


def _hashed(rows: DataFrame, key: str, directions: np.ndarray, middle: np.ndarray, tables: int) -> DataFrame:
    """(key, codes): a bucket per table, made of the sides of `middle` on which a vector lies."""
    bits = directions.shape[1] // tables
    places = 1 << np.arange(bits, dtype=np.int64)

    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if vectors.empty:
                yield pd.Series([], dtype=object)
                continue
            sides = (np.stack(vectors.to_numpy()) @ directions > middle).reshape(len(vectors), tables, bits)
            yield pd.Series(list((sides * places).sum(axis=2)))

    return rows.select(key, F.pandas_udf(codes, "array<long>")("vector").alias("codes"))


def lsh_pairs(asked: DataFrame, n: int, rows: DataFrame, dim: int, tables: int, bits: int) -> DataFrame:
    """(q_id, doc_id), once each: pairs whose buckets differ in one bit at most in some table."""
    # One number per dimension, summed in the map tasks.
    means = rows.select(F.posexplode("vector").alias("at", "value")).groupBy("at").agg(F.avg("value").alias("mean")).orderBy("at").collect()
    directions = planes(dim, tables * bits).astype(np.float64)
    middle = np.array([m.mean for m in means]) @ directions if means else np.zeros(tables * bits)
    flips = [0, *(1 << bit for bit in range(bits))]
    probes = _hashed(asked, "q_id", directions, middle, tables).select("q_id", F.col("codes").alias("q_codes"), F.posexplode("codes").alias("table", "own"))
    probes = probes.select("q_id", "q_codes", "table", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(f)) for f in flips])).alias("bucket"))
    held = _hashed(rows, "doc_id", directions, middle, tables).select("doc_id", "codes", F.posexplode("codes").alias("table", "bucket"))
    met = held.join(broadcast_if_small(probes, n * tables * len(flips)), ["table", "bucket"])
    # A pair that meets in several tables counts in the first of them.
    near = F.zip_with("codes", "q_codes", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 1)
    return met.where(F.array_position(near, True) == F.col("table") + 1).select("q_id", "doc_id")


def dense_topk_lsh(
    queries: DataFrame, corpus: DataFrame, k: int = 20, *, metric: str = "l2", tables: int = 16, bits: int = 8
) -> DataFrame:
    """Approximate k nearest: only vectors in or next to a question's bucket, in one of the tables, compete.

    Bits are sides of fixed planes through the corpus' mean. Buckets meet in one
    equi-join and distances are exact. A question with fewer than k such vectors
    is answered by the exact search, so it gets k rows where k vectors exist.
    More `bits` make buckets smaller (one more for each doubling of a large corpus
    keeps their size), more `tables` find more.
    """
    asked, n, dim = _asked(queries, metric)
    if not n:
        return corpus.sparkSession.createDataFrame([], FOUND)
    rows = _usable(corpus, "doc_id", metric).where(F.size("vector") == dim)
    pairs = lsh_pairs(asked, n, rows, dim, tables, bits)
    both = pairs.join(rows, "doc_id").join(broadcast_if_small(asked.withColumnRenamed("vector", "q"), n * dim // 8), "q_id")

    def total(left: str, right: str, term) -> Column:
        return F.aggregate(F.zip_with(left, right, term), F.lit(0.0), lambda s, x: s + x)

    if metric == "l2":
        distance = total("q", "vector", lambda a, b: (a - b) * (a - b))
    else:
        product = lambda a, b: a * b
        distance = 1.0 - total("q", "vector", product) / F.sqrt(total("q", "q", product)) / F.sqrt(total("vector", "vector", product))
    scored = both.select("q_id", "doc_id", (F.round(distance, DIGITS) + 0.0).alias("distance"))
    near = write_table(top_per_key(scored, "q_id", [F.col("distance"), F.col("doc_id")], k), "near")
    full = near.where(F.col("rank") == k).select("q_id")
    short = write_table(asked.join(full, "q_id", "left_anti"), "short")
    if short.isEmpty():
        return near
    return near.join(full, "q_id", "left_semi").unionByName(dense_topk(short, corpus, k, metric=metric))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours that were found."""
    hits = exact.join(found.select("q_id", "doc_id", F.lit(1).alias("hit")), ["q_id", "doc_id"], "left")
    return hits.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def label_means(vectors: DataFrame, *, label: str = "label", vector: str = "vector") -> DataFrame:
    """One mean vector per label. The sums are partial in the map tasks, so a
    label with a third of all vectors moves no more rows than any other."""
    means = (
        vectors.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "value"))
        .groupBy(label, "at")
        .agg(F.avg("value").alias("value"))
    )
    return means.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(vector)
    )
