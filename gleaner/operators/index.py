"""Documents to postings and corpus statistics, in the plan or as a written index.

The index is four tables:

- `docs`      doc_id, file_name, dl                    one row per document
- `postings`  bucket, term, doc_id, tf, dl, norm       one row per document and word
- `terms`     term, df, max_tf, min_dl, max_share      one row per word
- `corpus`    n_docs, avg_dl, mean_idf, buckets        one row

Written postings are partitioned by a hash bucket of the word, sorted by word, and
split by size: a batch of questions reads only the buckets its words fall in, and a
word that is in every document spreads over many files. The number of buckets is
the builder's choice and kept with the index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import tokens, unnest
from gleaner.session import BROADCAST_ROWS, new_folder, read_if_there, write_table

BUCKETS = 16


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def bucket_of(self, term: Column) -> Column:
        return bucket_of(term, self.corpus.select("buckets").scalar())


def bucket_of(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def counted_words(docs: DataFrame, *, unique: bool = False) -> DataFrame:
    """(doc_id, dl, term, tf, opens): one row per document and word, of one pass over (doc_id,
    file_name, text). `opens` holds the file name on the row of a document's first word and is
    NULL on the others; a document without words has one row, of a NULL term.

    A document's words are sorted and counted on its own row, so neither words nor counts are
    shuffled. Only where doc_ids repeat (looked up unless they are `unique`) are counts added up."""
    words = docs.select("doc_id", "file_name", tokens(F.col("text")).alias("words")).select(
        "doc_id", "file_name", F.size("words").cast("long").alias("dl"), F.get("words", F.lit(0)).alias("first"), F.sort_array("words").alias("words")
    )
    # Places, from 0, where another word begins.
    begins = F.filter(F.transform("words", lambda w, at: F.when((at == 0) | (w != F.get("words", at - 1)), at)), lambda at: at.isNotNull())
    words = words.withColumn("begins", begins)
    ends = lambda at: F.coalesce(F.get("begins", at + 1), F.size("words"))
    counts = F.transform("begins", lambda place, at: F.struct(F.get("words", place).alias("term"), (ends(at) - place).cast("long").alias("tf")))
    rows = words.select("doc_id", "file_name", "dl", "first", F.explode_outer(counts).alias("word"))
    opens = F.when(F.col("word.term").eqNullSafe(F.col("first")), F.struct("file_name"))
    rows = rows.select("doc_id", "dl", "word.term", F.coalesce("word.tf", F.lit(0)).cast("long").alias("tf"), opens.alias("opens"))
    if unique or docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"), F.max("opens").alias("opens"))


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, dl). Counting starts in the map tasks, so the shuffle
    carries one row per document and word, not one per word occurrence."""
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    return (
        unnest(words.withColumn("dl", F.size("words")), F.col("words"), "term", key, "dl")
        .groupBy(key, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .select(key, "term", "tf", F.col("dl").cast("long").alias("dl"))
    )


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, dl) for every document, also one without any word."""
    return docs.select("doc_id", "file_name", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def doc_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
    )


def raw_idf(df: Column, n_docs: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def smooth_idf(df: Column, n_docs: Column) -> Column:
    """ln((1+N)/(1+df)) + 1; never below 1, so a shared word always counts."""
    return F.log((n_docs + 1) / (df + 1)) + 1


def corpus_stats(lengths: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: n_docs, avg_dl and the mean of the raw idf over all words."""
    size = lengths.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_dl"))
    n_docs, avg_dl = size.select("n_docs").scalar(), size.select("avg_dl").scalar()
    return terms.agg(F.avg(raw_idf(F.col("df"), n_docs)).alias("mean_idf")).select(
        n_docs.alias("n_docs"), avg_dl.alias("avg_dl"), "mean_idf"
    )


def plan_index(docs: DataFrame) -> Index:
    """The four tables as lazy plans over (doc_id, file_name, text)."""
    lengths = doc_lengths(docs)
    counts = word_counts(docs)
    terms, buckets = doc_frequencies(counts), F.lit(BUCKETS)
    postings = _postings(lengths, counts, terms, buckets)
    shares = postings.groupBy("term").agg(F.max(F.col("tf") / F.col("norm")).alias("max_share"))
    corpus = corpus_stats(lengths, terms).withColumn("buckets", buckets)
    return Index(lengths, postings, terms.join(shares, "term"), corpus)


def _postings(lengths: DataFrame, counts: DataFrame, terms: DataFrame, buckets: Column) -> DataFrame:
    """Counts with the L2 norm of their document's tf-idf vector. Rows meet their word's df, then move to their document once:
    summing norms apart would bring a row per document from every task, and move the counts there all the same."""
    n_docs = lengths.select(F.count(F.lit(1))).scalar()
    weight = F.col("tf") * smooth_idf(F.col("df"), n_docs)
    norm = F.sqrt(F.sum(weight * weight).over(Window.partitionBy("doc_id")))
    return counts.where("doc_id is not null").join(terms.select("term", "df"), "term").select(
        bucket_of(F.col("term"), buckets).alias("bucket"), "term", "doc_id", "tf", "dl", norm.alias("norm")
    )


def _norms(counts: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, norm): the L2 norm of each document's tf-idf vector, of written counts and frequencies.

    A document's counts lie in one task, so where their words' df is at hand they are summed there. The commonest words
    that fit a broadcast, most of all counts, have it at hand; only the counts of the other, rare words move to meet it."""
    # By the binary length of df: some 40 rows.
    sizes = frequencies.groupBy(F.length(F.bin("df")).alias("size")).count().orderBy(F.desc("size")).collect()
    least, held = 2**62, 0
    for size, n_words in sizes:
        held += n_words
        if held > BROADCAST_ROWS:
            break
        least = 2 ** (size - 1)
    weight = F.col("tf") * smooth_idf(F.col("df"), F.lit(n_docs))
    common = frequencies.where(F.col("df") >= least).select("term", "df")
    rare = F.when(F.col("df").isNull(), F.col("term"))
    met = counts.join(F.broadcast(common), "term", "left").groupBy("doc_id", rare.alias("term")).agg(F.sum(weight * weight).alias("square"), F.sum("tf").alias("tf"))
    met = write_table(met, "squares")
    found = met.where("term is null").select("doc_id", "square")
    if held > BROADCAST_ROWS:
        others = met.where("term is not null").drop("square").join(frequencies.select("term", "df"), "term")
        found = found.unionByName(others.select("doc_id", (weight * weight).alias("square")))
    return found.groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm"))


def _normed(counts: DataFrame, norms: DataFrame, n_docs: int, buckets: int) -> Iterator[DataFrame]:
    """Postings of one bounded part of the documents after the other. Counts meet their norm where they are; they move once, to their bucket."""
    parts = math.ceil(n_docs / BROADCAST_ROWS)
    for part in range(parts):
        some = norms if parts == 1 else norms.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == part)
        rows = counts.join(F.broadcast(some), "doc_id")
        rows = rows.select(bucket_of(F.col("term"), F.lit(buckets)).alias("bucket"), "term", "doc_id", "tf", "dl", "norm")
        # Partitions are split and merged by size at run time; nothing is sampled beforehand.
        yield rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "doc_id")


def build_index(docs: DataFrame, path: str, *, buckets: int = BUCKETS) -> int:
    """Index (doc_id, file_name, text) under `path`; the number of indexed documents. Texts are read and
    tokenized once. Postings of some 100 MB a bucket suit a large corpus, hence `buckets`."""
    return write_index(write_table(counted_words(docs), "counted"), path, buckets=buckets)


def write_index(counted: DataFrame, path: str, *, buckets: int = BUCKETS) -> int:
    """Write a full index of written `counted_words` under a new folder of `path` and make it the current one.

    Returns the number of indexed documents. Nothing is replaced before the
    new tables are complete, so a failed build leaves the old index in use.
    """
    spark = counted.sparkSession
    home = f"{path}/{new_folder(spark, 'staging').rsplit('/', 1)[1]}"
    lengths = counted.where("opens is not null").select("doc_id", "opens.file_name", "dl")
    if lengths.isEmpty():
        raise RuntimeError("No documents to index.")
    lengths.write.parquet(f"{home}/docs")
    lengths = spark.read.parquet(f"{home}/docs")
    chunks = lengths.count()
    counts = counted.where("term is not null").select("doc_id", "term", "tf", "dl")
    frequencies = write_table(doc_frequencies(counts), "frequencies")

    counts = counts.where("doc_id is not null")
    norms = write_table(_norms(counts, frequencies, chunks), "norms")
    for part in _normed(counts, norms, chunks, buckets):
        part.write.mode("append").partitionBy("bucket").parquet(f"{home}/postings")
    shares = (
        spark.read.parquet(f"{home}/postings")
        .groupBy("term")
        .agg(F.max(F.col("tf") / F.col("norm")).alias("max_share"))
    )
    frequencies.join(shares, "term").write.parquet(f"{home}/terms")
    corpus_stats(lengths, frequencies).withColumn("buckets", F.lit(buckets)).write.parquet(f"{home}/corpus")

    spark.range(1).select(
        F.lit(home).alias("home"), F.current_timestamp().alias("built_at"), F.lit(chunks).alias("chunks")
    ).write.mode("append").parquet(f"{path}/builds")
    return chunks


def read_index(spark: SparkSession, path: str) -> Index:
    """The newest complete index under `path`; an error if there is none or it is empty."""
    builds = read_if_there(spark, f"{path}/builds")
    if builds is None:
        raise RuntimeError(f"No index at {path}. Build one first.")
    newest = builds.agg(F.max_by(F.struct("home", "chunks"), "built_at").alias("build")).first()
    if newest is None or newest.build is None or newest.build.chunks == 0:
        raise RuntimeError(f"The index at {path} is empty. Build it first.")
    home = newest.build.home
    return Index(*(spark.read.parquet(f"{home}/{name}") for name in ("docs", "postings", "terms", "corpus")))


def tfidf_vectors(docs: DataFrame) -> DataFrame:
    """Sparse unit vectors: one (doc_id, term, weight) row per document and word."""
    counts = counted_words(docs.select("doc_id", F.lit("").alias("file_name"), "text")).where("term is not null")
    counts = write_table(counts.select("doc_id", "term", "tf"), "counts")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * smooth_idf(F.col("df"), n_docs)
    weights = counts.join(terms, "term").select("doc_id", "term", weight.alias("weight"))
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, "doc_id").select("doc_id", "term", (F.col("weight") / F.col("norm")).alias("weight"))
