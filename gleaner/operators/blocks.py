"""BM25 over postings in blocks that know their largest impact.

Documents are dealt to blocks of about `block_docs` by a hash. `packed` holds a row per (word, block) with the block's
postings as one array; `bounds` the same rows without postings, but with the largest impact among them. A batch
of questions reads bounds for all its words and postings only where a document could still reach a question's floor:

1. All blocks of each question's rarest words are read. The best documents so far are looked up in their blocks of
   the other words: the k-th complete score is a floor below which no result can be.
2. Per (question, block) the bounds of the other words say how much a document there can still gain.
3. Blocks of the other words are read where that gain alone comes up to the floor, or where it lifts a document that
   the rare words found up to it. All others are skipped.

Steps 2 and 3 run in groups of blocks: a task holds the bounds, then the postings, of its own blocks and goes through the
questions one by one. Bounds and postings move once, whatever the number of questions, and a task gives the best k of each.

The rows are those of `search.bm25_topk`. More documents make blocks with candidates rarer: at scale blocks
of some thousand documents do, small corpora need small ones.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.index import Index
from gleaner.operators.search import BLOCK_POSTINGS, DIGITS, PART_WORDS, SLACK, _best, bm25_impact, bm25_words, top_per_key
from gleaner.session import broadcast_if_small, new_folder, write_table

BLOCK_DOCS = 1024
WORD_BLOCK = ["bucket", "term", "block"]

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Blocks:
    index: Index
    packed: DataFrame
    bounds: DataFrame
    n_blocks: int
    k1: float
    b: float


def block_of(doc_id: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(n_blocks)).cast("int")


def build_blocks(index: Index, path: str, *, block_docs: int = BLOCK_DOCS, k1: float = 1.5, b: float = 0.75) -> None:
    """Pack the postings of a written index under a new folder of `path`. Bounds hold for these k1 and b."""
    spark = index.postings.sparkSession
    n_docs, avg_dl = index.corpus.select("n_docs", "avg_dl").first()
    n_blocks = max(1, -(-n_docs // block_docs))
    home = f"{path}/{new_folder(spark, 'blocks').rsplit('/', 1)[1]}"
    impact = bm25_impact(F.col("tf"), F.col("dl"), F.lit(avg_dl), k1, b)
    # Postings move once, to their bucket and range of blocks: some 250,000 together, however common the words.
    n_postings = index.terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    n_ranges = math.ceil(max(1, n_postings) / (BLOCK_POSTINGS // 4) / index.corpus.select("buckets").first()[0])
    # Blocks are worked out again there, so that they do not move.
    block = block_of(F.col("doc_id"), n_blocks)
    dealt = index.postings.select("bucket", "term", "doc_id", "tf", "dl")
    dealt = dealt.repartition(math.ceil(max(1, n_postings) / BLOCK_POSTINGS), F.col("bucket"), block % n_ranges)
    dealt = dealt.withColumns({"block": block, "range": block % n_ranges})
    # A group is a word's postings in one block: bounded, however common the word.
    grouped = dealt.groupBy("range", *WORD_BLOCK)
    packed = grouped.agg(F.max(impact).alias("max_impact"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("postings"))
    packed.drop("range").sortWithinPartitions(*WORD_BLOCK).write.partitionBy("bucket").parquet(f"{home}/packed")
    meta = spark.range(1).select(F.lit(home).alias("home"), F.current_timestamp().alias("built_at"), *[F.lit(v).alias(c) for c, v in (("n_blocks", n_blocks), ("k1", k1), ("b", b))])
    meta.write.mode("append").parquet(f"{path}/builds")


def read_blocks(spark: SparkSession, path: str, index: Index) -> Blocks:
    """The newest blocks under `path`. The columns are stored apart, so bounds are read without postings."""
    newest = spark.read.parquet(f"{path}/builds").orderBy(F.desc("built_at")).first()
    packed = spark.read.parquet(f"{newest.home}/packed")
    return Blocks(index, packed.select(*WORD_BLOCK, "postings"), packed.select(*WORD_BLOCK, "max_impact"), newest.n_blocks, newest.k1, newest.b)


def _added(found: DataFrame, keys: list[str], impact) -> DataFrame:
    """Scores summed per `keys` over blocks (postings) met by words (weight)."""
    each = found.select("*", F.explode("postings").alias("p")).withColumn("doc_id", F.col("p.doc_id"))
    return each.withColumn("part", F.col("weight") * impact(F.col("p.tf"), F.col("p.dl"))).groupBy(*keys).agg(F.sum("part").alias("score"))


def _needs(bounds: pd.DataFrame, found: pd.DataFrame, q_ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray, weights: np.ndarray, floors: np.ndarray) -> pd.DataFrame:
    """The questions that read each block of a group; question i has the words `starts[i]` to `starts[i + 1]`."""
    names, at = np.unique(bounds["block"].to_numpy(dtype=np.int64), return_inverse=True)
    # A block without words that are not rare has nothing to read.
    found = found[np.isin(found["block"].to_numpy(), names)]
    leads = np.zeros((len(q_ids), len(names)))
    np.maximum.at(leads, (np.searchsorted(q_ids, found["q_id"]), np.searchsorted(names, found["block"])), found["score"].to_numpy(dtype=np.float64))
    order = np.argsort(bounds["number"].to_numpy(), kind="stable")
    at, most = at[order], bounds["max_impact"].to_numpy(dtype=np.float64)[order]
    places = np.searchsorted(bounds["number"].to_numpy()[order], np.arange(numbers.max(initial=-1) + 2))
    reads = np.zeros((len(names), len(q_ids)), dtype=bool)
    for i in range(len(q_ids)):
        gains, met = np.zeros(len(names)), np.zeros(len(names), dtype=bool)
        for place in range(starts[i], starts[i + 1]):
            some = slice(places[numbers[place]], places[numbers[place] + 1])
            # A word of negative weight adds nothing at best. Questions without a floor read everything.
            gains[at[some]] += max(weights[place], 0.0) * most[some]
            met[at[some]] = True
        reads[:, i] = met & (gains + leads[i] >= floors[i])
    held = np.flatnonzero(reads.any(axis=1))
    return pd.DataFrame({"block": names[held].astype(np.int32), "q_ids": pd.Series([q_ids[reads[row]] for row in held], dtype=object)})


def _group_best(met: pd.DataFrame, given: pd.DataFrame, q_ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray, weights: np.ndarray, k: int) -> pd.DataFrame:
    """The best k documents of a group for every question. `given` has the scores of rare words (q_id, doc_id, score) and the questions that read a block (block, q_ids)."""
    is_read = given["q_ids"].notna().to_numpy()
    reads, found = given[is_read], given[~is_read]
    held = np.unique(reads["block"].to_numpy(dtype=np.int64))
    needed = np.zeros((len(q_ids), len(held)), dtype=bool)
    for block, askers in zip(reads["block"], reads["q_ids"]):
        needed[np.searchsorted(q_ids, askers), np.searchsorted(held, block)] = True
    met = met[np.isin(met["block"].to_numpy(), held)]
    ids, docs = np.unique(np.concatenate([met["doc_id"].to_numpy(), found["doc_id"].to_numpy()]) if len(met) else found["doc_id"].to_numpy(), return_inverse=True)
    docs, found_docs = docs[: len(met)], docs[len(met) :]
    block = np.zeros(len(ids), dtype=np.int64)
    block[docs] = np.searchsorted(held, met["block"].to_numpy())
    keys, places = np.unique(met["number"].to_numpy(dtype=np.int64) * len(ids) + docs, return_inverse=True)
    # Documents of one id count as one.
    impacts = np.bincount(places, met["impact"].to_numpy(dtype=np.float64))
    docs = keys % max(1, len(ids))
    places = np.searchsorted(keys, np.arange(numbers.max(initial=-1) + 2) * len(ids))
    order = np.argsort(found["q_id"].to_numpy(), kind="stable")
    found_docs, found_scores = found_docs[order], found["score"].to_numpy(dtype=np.float64)[order]
    found_at = np.append(np.searchsorted(found["q_id"].to_numpy()[order], q_ids), len(found))
    best = [(np.empty(0, dtype=np.int64), ids[:0], np.empty(0))]
    for i, q_id in enumerate(q_ids):
        mine = slice(found_at[i], found_at[i + 1])
        scores = np.zeros(len(ids))
        scores[found_docs[mine]] = found_scores[mine]
        for place in range(starts[i], starts[i + 1]):
            some = slice(places[numbers[place]], places[numbers[place] + 1])
            scores[docs[some]] += weights[place] * impacts[some] * needed[i, block[docs[some]]]
        rounded = np.round(scores, DIGITS)
        limit = max(np.partition(rounded, -k)[-k] if len(rounded) > k else 0.0, 10.0**-DIGITS / 2)
        near = np.flatnonzero(rounded >= limit)
        # `ids` ascend, and so do equal scores.
        near = near[np.argsort(-rounded[near], kind="stable")[:k]]
        best.append((np.full(len(near), q_id, dtype=np.int64), ids[near], scores[near]))
    q_id, doc_id, score = (np.concatenate(column) for column in zip(*best))
    return pd.DataFrame({"q_id": q_id, "doc_id": doc_id, "score": score})


def _reader(shared: Broadcast) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda bounds, found: _needs(bounds, found, *shared.value)


def _scorer(shared: Broadcast, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda met, given: _group_best(met, given, *shared.value[:-1], k)


@dataclass(frozen=True)
class _Search:
    """`words` of the questions, `rare` or not; `scores`, complete up to rows that cannot win; `single`: q_id, bucket, term,
    block of the blocks read of words that are not rare."""

    words: DataFrame
    scores: DataFrame
    single: DataFrame


def _search(questions: DataFrame, blocks: Blocks, k: int, first_docs: int | None) -> _Search:
    """`questions` have numbers for q_ids."""
    index, packed = blocks.index, blocks.packed
    avg_dl = index.corpus.select("avg_dl").first()[0]

    def impact(tf: Column, dl: Column) -> Column:
        return bm25_impact(tf, dl, F.lit(avg_dl), blocks.k1, blocks.b)

    rarest_first = Window.partitionBy("q_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rarest_first), F.lit(0))
    known = bm25_words(questions, index, k1=blocks.k1, b=blocks.b)
    words = write_table(known.withColumn("rare", before < (first_docs or 50 * k)).select("q_id", "bucket", "term", "df", "weight", "rare"), "question-words")
    n = words.count()
    other = words.where("not rare").select("q_id", "bucket", "term", "weight")

    met = packed.join(broadcast_if_small(words.where("rare"), n), ["bucket", "term"])
    found = write_table(_added(met, ["q_id", "doc_id", "block"], impact), "found")
    order = [F.desc("score"), F.col("doc_id")]
    best = top_per_key(found, "q_id", order, 2 * k).select("q_id", "doc_id", "block", "score")
    # At most 2k documents per question are looked up.
    lookups = write_table(best.join(other, "q_id"), "lookups")
    looked = packed.join(broadcast_if_small(lookups.select("q_id", F.col("doc_id").alias("wanted"), *WORD_BLOCK, "weight"), 2 * k * n), WORD_BLOCK)
    looked = looked.withColumn("postings", F.filter("postings", lambda p: p["doc_id"] == F.col("wanted")))
    complete = best.select("q_id", "doc_id", "score").unionByName(_added(looked, ["q_id", "doc_id"], impact))
    complete = complete.groupBy("q_id", "doc_id").agg(F.sum("score").alias("score"))
    floors = top_per_key(complete, "q_id", order, k).where(F.col("rank") == k).select("q_id", (F.col("score") - SLACK).alias("floor"))
    floors = write_table(floors, "floors")

    parts = math.ceil(n / PART_WORDS)
    parts = 1 if parts <= 1 else 2 * parts
    in_part = F.pmod(F.xxhash64("q_id"), F.lit(parts))
    done = [_in_groups(*(t.where(in_part == part) for t in (words, found, floors)), blocks, k, impact) for part in range(parts if n else 0)]
    scores = reduce(DataFrame.unionByName, (scores for scores, _ in done)) if done else found.select("q_id", "doc_id", "score")
    single = lookups.select("q_id", *WORD_BLOCK)
    for _, reads in done:
        read = reads.select("block", F.explode("q_ids").alias("q_id")).join(broadcast_if_small(other, n), "q_id")
        single = single.unionByName(read.select("q_id", *WORD_BLOCK))
    return _Search(words, scores, single.distinct())


def _in_groups(words: DataFrame, found: DataFrame, floors: DataFrame, blocks: Blocks, k: int, impact: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(q_id, doc_id, score) that hold the best k, and (block, q_ids): the questions that read each block, for one bounded part of the questions."""
    spark = words.sparkSession
    asked = words.toPandas().sort_values(["q_id", "term"], kind="stable")
    q_ids, other = np.unique(asked["q_id"].to_numpy(dtype=np.int64)), asked[~asked["rare"].astype(bool)]
    numbers, terms = pd.factorize(other["term"])
    starts = np.append(np.searchsorted(other["q_id"], q_ids), len(other))
    least = floors.toPandas().set_index("q_id")["floor"].reindex(q_ids).fillna(float("-inf")).to_numpy(dtype=np.float64)
    shared = spark.sparkContext.broadcast((q_ids, starts, numbers, other["weight"].to_numpy(dtype=np.float64), least))

    once = other.drop_duplicates("term")
    # Postings, scores and (question, block) places of a group: tens of MB.
    n_groups = math.ceil(max(1, int(once["df"].sum()) + found.count() + len(q_ids) * blocks.n_blocks) / BLOCK_POSTINGS)
    group = (F.col("block") % n_groups).alias("group")
    numbered = spark.createDataFrame(once[["bucket", "term"]].assign(number=np.arange(len(terms))), "bucket int, term string, number long")
    numbered = broadcast_if_small(numbered, len(terms))
    buckets = sorted({int(b) for b in once["bucket"]})
    in_buckets = F.col("bucket").isin(buckets) if len(buckets) < 1000 else F.lit(True)

    bounds = blocks.bounds.where(in_buckets).join(numbered, ["bucket", "term"]).select(group, "block", "number", "max_impact")
    leads = found.select(group, "q_id", "block", "score")
    reads = bounds.groupBy("group").cogroup(leads.groupBy("group")).applyInPandas(_reader(shared), "block int, q_ids array<long>")
    reads = write_table(reads, "reads")

    met = blocks.packed.where(in_buckets).join(numbered, ["bucket", "term"]).select("block", "number", F.explode("postings").alias("p"))
    met = met.select(group, "block", "number", "p.doc_id", impact(F.col("p.tf"), F.col("p.dl")).alias("impact"))
    given = found.select(group, "block", "q_id", "doc_id", "score").unionByName(reads.select(group, "block", "q_ids"), allowMissingColumns=True)
    kind = found.schema["doc_id"].dataType.simpleString()
    scores = met.groupBy("group").cogroup(given.groupBy("group")).applyInPandas(_scorer(shared, k), f"q_id long, doc_id {kind}, score double")
    return scores, reads


def _numbered(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The questions under numbers, and (q_id, number)."""
    names = write_table(questions.select("q_id").distinct().withColumn("number", F.monotonically_increasing_id()), "question-numbers")
    asked = questions.join(names.withColumnRenamed("q_id", "named"), F.col("q_id").eqNullSafe(F.col("named")))
    return asked.select(F.col("number").alias("q_id"), "question"), names


def bm25_topk_blocks(questions: DataFrame, blocks: Blocks, k: int = 20, *, first_docs: int | None = None) -> DataFrame:
    """(q_id, doc_id, score, rank): the rows of `search.bm25_topk`, read from blocks. `first_docs`, the postings that a
    question's rare words may have, moves work between the steps, never results."""
    asked, names = _numbered(questions)
    best = _best(_search(asked, blocks, k, first_docs).scores, k)
    return best.withColumnRenamed("q_id", "number").join(names, "number").select("q_id", "doc_id", "score", "rank")


def block_reads(questions: DataFrame, blocks: Blocks, k: int = 20, *, common: float = 0.1, first_docs: int | None = None) -> DataFrame:
    """(is_common, n_blocks, n_read): of the blocks of the questions' words, once per question, how many their search
    reads; apart for words in more than a `common` share of the documents."""
    done = _search(_numbered(questions)[0], blocks, k, first_docs)
    n_docs = blocks.index.corpus.select("n_docs").first()[0]
    every = done.words.select("q_id", "bucket", "term", "rare", (F.col("df") > common * n_docs).alias("is_common")).join(blocks.bounds, ["bucket", "term"])
    marked = every.join(done.single.withColumn("single", F.lit(True)), ["q_id", *WORD_BLOCK], "left")
    return marked.groupBy("is_common").agg(F.count(F.lit(1)).alias("n_blocks"), F.count(F.when(F.col("rare") | F.col("single"), 1)).alias("n_read"))
