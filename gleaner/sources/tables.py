"""The driver's parquet tables, and the documents, questions and vectors made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank


class Tables:
    """Attribute access to the parquet tables of one folder: `Tables(spark, dir).orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows out to all cores when the scan has fewer splits than that, as
    with one small file. A scan of many splits is left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def named_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, file_name, text) without blank documents."""
    return spread(documents.select("doc_id", "text"), "doc_id").where(~is_blank(F.col("text"))).select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), "text"
    )


def benchmark_questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def vector_corpus(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
