"""A training corpus from `documents`: good text, no repeated lines, one of each near-duplicate
group, no benchmark text, mixed to target weights. Each stage takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontam, linedup, mixing, quality, simhash
from gleaner.session import write_table
from gleaner.sources.tables import Tables


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from `documents` and `labels`
    of the folder, so the same model judges whatever comes in."""
    tables = Tables(spark, sf_dir)
    score = quality.quality(tables.documents, tables.labels)
    return docs.withColumn("_quality", score).where(f"_quality >= {quality.THRESHOLD}").drop("_quality")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes the later copies of repeated line runs from the texts; every document stays."""
    return linedup.without_repeats(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each SimHash group: 3-word shingles, fingerprints within 2 bits."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by `benchmark`."""
    return decontam.keep_clean(docs, Tables(spark, sf_dir).benchmark)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, with how many words it takes and the pieces in each shard."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed_sources),
]

# Scores of a trained model and XXH64 fingerprints are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
