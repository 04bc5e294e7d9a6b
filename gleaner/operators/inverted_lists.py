"""Approximate nearest neighbours by inverted lists: vectors filed under the nearest of a set of centroids.

The index outlives the query: `lists` (list, doc_id, vector) partitioned by list, `centroids` (list, centroid,
n_rows) and `meta` (one row). A search reads only the files of the lists that some question probes.

Centroids come from k-means over whole numbers: components are scaled by a power of two and rounded, so sums
and comparisons are exact and the lists are the same however the rows are dealt. They are fitted on a bounded
sample (`TRAIN_ROWS` rows of smallest hash); every vector is filed. How many lists a question probes is
measured when the index is built: the least number that finds `recall` of the exact neighbours of `AUDIT`
vectors of the corpus, by brute force. A question goes on to further lists until these hold k vectors.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import dense
# By name: a task that got the module `dense` would import what that imports.
from gleaner.operators.dense import _distances, _keep_best
from gleaner.operators.search import top_per_key
from gleaner.session import new_folder, write_table

TRAIN_ROWS = 65_536
MAX_LISTS = 4_096
ROUNDS = 6
AUDIT = 64
AUDIT_K = 20
RECALL = 0.95
# A typical component is scaled to 2^10 and more; none counts for more than 2^20, so distances stay exact in a double.
TYPICAL, LARGEST = 10, 1 << 20

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Lists:
    """A written index: its tables, and the centroids (bounded by `MAX_LISTS`) as arrays."""

    lists: DataFrame
    centroids: np.ndarray
    n_rows: np.ndarray
    metric: str
    dim: int
    scale: float
    probes: int


def whole_numbers(vectors: np.ndarray, metric: str, scale: float) -> np.ndarray:
    """The scaled and rounded vectors, exact whole numbers as doubles; unit vectors for cosine."""
    if metric == "cosine":
        vectors = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
    return np.clip(np.floor(vectors * scale + 0.5), -LARGEST, LARGEST)


def by_nearness(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Lists in order of their centroids' distance from each row, equal ones by number."""
    return np.argsort((centroids**2).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T), axis=1, kind="stable")


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T), axis=1)


def _hash_order(key: str):
    return F.md5(F.col(key).cast("string"))


def _scale(rows: DataFrame, metric: str) -> float:
    """The power of two that brings a component of mean size to 2^TYPICAL or a little more."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) if metric == "cosine" else F.lit(1.0)
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x)) / length
    mean = rows.select(size.alias("size"), F.size("vector").alias("dim")).agg(F.sum("size") / F.sum("dim")).first()[0]
    return 2.0 ** (TYPICAL - math.floor(math.log2(mean))) if mean else 1.0


def _fit(sample: DataFrame, n_lists: int, metric: str, scale: float) -> np.ndarray:
    """k-means from the `n_lists` sample rows of smallest hash; a centroid that no row is nearest to stays."""
    spark = sample.sparkSession
    # At most MAX_LISTS rows.
    firsts = sample.orderBy(_hash_order("doc_id"), "doc_id").limit(n_lists).toPandas()
    centroids = whole_numbers(np.stack(firsts["vector"].to_numpy()).astype(np.float64), metric, scale)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            count = np.zeros(len(total), dtype=np.int64)
            for batch in batches:
                if len(batch):
                    x = whole_numbers(np.stack(batch["vector"].to_numpy()).astype(np.float64), metric, scale)
                    near = _nearest(x, shared.value)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(total))
            held = np.flatnonzero(count)
            # A task without rows, as of a split without a row group, gives none: an empty column of lists has no type.
            if len(held):
                yield pd.DataFrame({"list": held, "n": count[held], "total": list(total[held])})

        # A row per task and list comes in, one per list goes out.
        partial = sample.mapInPandas(sums, "list long, n long, total array<double>").select("list", "n", F.posexplode("total").alias("at", "x"))
        whole = partial.groupBy("list", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
        centroids = centroids.copy()
        centroids[whole["list"], whole["at"]] = np.floor(whole["x"] / whole["n"])
    return centroids


def _filed(rows: DataFrame, centroids: np.ndarray, metric: str, scale: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def file(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, shared.value.shape[1]))
            yield pd.Series(_nearest(whole_numbers(x, metric, scale), shared.value).astype(np.int32))

    return rows.select(F.pandas_udf(file, "int")("vector").alias("list"), "doc_id", "vector")


def _needed_probes(rows: DataFrame, filed: DataFrame, centroids: np.ndarray, metric: str, scale: float, recall: float) -> int:
    """The least number of nearest lists that hold `recall` of the exact neighbours of the audited vectors, themselves apart."""
    audited = rows.orderBy(_hash_order("doc_id"), "doc_id").limit(AUDIT).select(F.col("doc_id").alias("q_id"), "vector")
    audited = write_table(audited, "audited")
    exact = dense.dense_topk(audited, rows, AUDIT_K + 1, metric=metric).where("q_id <> doc_id and rank <= %d" % (AUDIT_K + 1))
    exact = top_per_key(exact.drop("rank"), "q_id", [F.col("distance"), F.col("doc_id")], AUDIT_K)
    # At most AUDIT * AUDIT_K rows.
    found = filed.select("list", "doc_id").join(F.broadcast(exact.select("q_id", "doc_id")), "doc_id").select("q_id", "list").toPandas()
    asked = audited.toPandas()
    order = by_nearness(whole_numbers(np.stack(asked["vector"].to_numpy()).astype(np.float64), metric, scale), centroids)
    place = {q: np.argsort(o) + 1 for q, o in zip(asked["q_id"], order)}
    places = sorted(place[q][held] for q, held in zip(found["q_id"], found["list"]))
    return int(places[math.ceil(recall * len(places) - 1e-9) - 1]) if places else 1


def build_lists(corpus: DataFrame, path: str, *, metric: str = "l2", n_lists: int | None = None, recall: float = RECALL) -> int:
    """File all vectors of (doc_id, vector) under a new folder of `path` and make that the current index; the number filed.

    Vectors of the most common length that have distances (`dense`) are filed. There are about sqrt(rows) lists,
    `MAX_LISTS` at most, unless `n_lists` says otherwise. No usable vector: an error.
    """
    if metric not in dense.METRICS:
        raise ValueError(f"metric must be one of {dense.METRICS}")
    spark = corpus.sparkSession
    usable = dense._usable(corpus, "doc_id", metric)
    lengths = usable.groupBy(F.size("vector").alias("dim")).count().agg(F.max_by("dim", F.struct("count", -F.col("dim"))).alias("dim"), F.max("count").alias("n")).first()
    if not lengths.n:
        raise RuntimeError("No vectors to index.")
    rows = usable.where(F.size("vector") == lengths.dim)
    n_lists = n_lists or min(MAX_LISTS, max(1, round(math.sqrt(lengths.n))))
    scale = _scale(rows, metric)
    least = f"{min(2**32, math.ceil(2**32 * TRAIN_ROWS / lengths.n)):09x}"
    drawn = F.concat(F.lit("0"), F.substring(_hash_order("doc_id"), 1, 8))
    sample = write_table(rows.where(drawn < least), "sample")
    centroids = _fit(sample, min(n_lists, sample.count()), metric, scale)

    home = f"{path}/{new_folder(spark, 'lists').rsplit('/', 1)[1]}"
    # Sizes even out at run time: a list with a third of the rows becomes several files.
    _filed(rows, centroids, metric, scale).hint("rebalance", F.col("list")).write.partitionBy("list").parquet(f"{home}/lists")
    filed = spark.read.parquet(f"{home}/lists")
    counts = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}
    probes = _needed_probes(rows, filed, centroids, metric, scale, recall)
    held = [(i, [float(x) for x in c], counts.get(i, 0)) for i, c in enumerate(centroids)]
    spark.createDataFrame(held, "list int, centroid array<double>, n_rows long").coalesce(1).write.parquet(f"{home}/centroids")
    meta = spark.range(1).select(
        F.lit(home).alias("home"), F.current_timestamp().alias("built_at"), F.lit(metric).alias("metric"), F.lit(lengths.dim).alias("dim"),
        F.lit(scale).alias("scale"), F.lit(probes).alias("probes"), F.lit(recall).alias("recall"),
    )
    meta.write.mode("append").parquet(f"{path}/builds")
    return lengths.n


def read_lists(spark: SparkSession, path: str) -> Lists:
    """The newest index under `path`."""
    newest = spark.read.parquet(f"{path}/builds").orderBy(F.desc("built_at")).first()
    held = spark.read.parquet(f"{newest.home}/centroids").orderBy("list").toPandas()
    lists = spark.read.parquet(f"{newest.home}/lists")
    return Lists(lists, np.stack(held["centroid"].to_numpy()), held["n_rows"].to_numpy(), newest.metric, newest.dim, newest.scale, newest.probes)


def probed(vectors: np.ndarray, index: Lists, k: int, probes: int | None) -> np.ndarray:
    """(questions, lists) of truth values: the lists that each question reads."""
    order = by_nearness(whole_numbers(vectors, index.metric, index.scale), index.centroids)
    held = np.cumsum(index.n_rows[order], axis=1)
    before = np.concatenate([np.zeros((len(order), 1), dtype=held.dtype), held[:, :-1]], axis=1)
    takes = (np.arange(order.shape[1])[None, :] < (probes or index.probes)) | (before < k)
    out = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(out, order, takes, axis=1)
    return out


def _search_block(index: Lists, asked: pd.DataFrame, k: int, probes: int | None) -> DataFrame:
    spark = index.lists.sparkSession
    vectors = np.stack(asked["vector"].to_numpy()).astype(np.float64)
    reads = probed(vectors, index, k, probes)
    metric = index.metric
    shared = spark.sparkContext.broadcast((asked["q_id"].to_numpy(), vectors, reads))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_vectors, q_reads = shared.value
        best: list = [None] * len(q_ids)
        for batch in batches:
            # A batch may hold several lists; each meets the questions that probe it.
            for number, part in batch.groupby("list", sort=False):
                ids, held = part["doc_id"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float64)
                takers = np.flatnonzero(q_reads[:, number])
                step = max(1, 4_000_000 // len(ids))
                for start in range(0, len(takers), step):
                    some = takers[start : start + step]
                    for at, near in zip(some, _distances(metric, held, q_vectors[some]).T):
                        best[at] = _keep_best(best[at], ids, near, k)
        found = [(q, *kept) for q, kept in zip(q_ids, best) if kept is not None]
        if found:
            sizes = [len(ids) for _, ids, _ in found]
            columns = (np.repeat([q for q, _, _ in found], sizes), *(np.concatenate(c) for c in list(zip(*found))[1:]))
            yield pd.DataFrame(dict(zip(("q_id", "doc_id", "distance"), columns)))

    wanted = np.flatnonzero(reads.any(axis=0) & (index.n_rows > 0))
    rows = index.lists if len(wanted) == (index.n_rows > 0).sum() else index.lists.where(F.col("list").isin([int(i) for i in wanted]))
    return rows.select("list", "doc_id", "vector").mapInPandas(scan, "q_id long, doc_id long, distance double")


def search_lists(queries: DataFrame, index: Lists, k: int = 20, *, probes: int | None = None) -> DataFrame:
    """(q_id, doc_id, distance, rank) of (q_id, vector): the k nearest among the vectors of each question's lists, by exact distance.

    Questions pass in blocks of `dense.BLOCK_BYTES`; a block reads each list's files once, and only the lists it probes.
    Questions without distances, or of another length than the index, find nothing.
    """
    asked = write_table(dense._usable(queries, "q_id", index.metric).where(F.size("vector") == index.dim), "query-vectors")
    n = asked.count()
    if not n:
        return queries.sparkSession.createDataFrame([], dense.FOUND)
    blocks = math.ceil(n * (index.dim * 8 + len(index.n_rows)) / dense.BLOCK_BYTES)
    blocks = 1 if blocks == 1 else 2 * blocks
    found = None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == block)).toPandas()
        if len(part):
            near = _search_block(index, part, k, probes)
            found = near if found is None else found.unionByName(near)
    return top_per_key(found, "q_id", [F.col("distance"), F.col("doc_id")], k)
