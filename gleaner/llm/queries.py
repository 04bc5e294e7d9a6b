"""The registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gleaner.llm import decontam, hnsw, langid, linedup, mixing, order_minhash, prefix_trie, quality, repair, simhash, substring, toxicity, urls
from gleaner.sources.tables import Tables


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.op1_simhash(Tables(spark, folder).documents)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return quality.op2_quality(tables.documents, tables.labels)


def op3_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.op3_substring(Tables(spark, folder).documents)


def op4_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.op4_embeddings(Tables(spark, folder).embeddings)


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.op5_mixing(Tables(spark, folder).documents)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return toxicity.op6_toxicity(tables.documents, tables.labels)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return decontam.op7_decontamination(tables.documents, tables.benchmark)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.op8_language(Tables(spark, folder).documents)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.op9_line_dedup(Tables(spark, folder).documents)


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.op10_urls(Tables(spark, folder).pages)


def op11_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.op11_order_minhash(Tables(spark, folder).documents)


def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.op12_structure_repair(Tables(spark, folder).conversations)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.op13_prefix_trie(Tables(spark, folder).conversations)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_quality, op3_substring, op4_embeddings, op5_mixing, op6_toxicity, op7_decontamination,
        op8_language, op9_line_dedup, op10_urls, op11_order_minhash, op12_structure_repair, op13_prefix_trie,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES = {
    "op5_mixing": mixing.SQL, "op7_decontamination": decontam.SQL, "op9_line_dedup": linedup.SQL, "op13_prefix_trie": prefix_trie.SQL,
}
