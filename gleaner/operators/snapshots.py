"""Fingerprints of a corpus, what changed between two snapshots, and the refresh decision.

Documents are (doc_id, file_name, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 8


def document_hash() -> Column:
    """SHA-256 over a document's name and text."""
    return F.sha2(F.concat_ws("\n", "file_name", "text"), 256)


def document_hashes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", document_hash().alias("sha"))


def fingerprint(hashes: DataFrame, settings: str = "") -> DataFrame:
    """One row: n_docs, and a digest that changes with any document or setting.

    The 256 bits of each document hash are added up in eight lanes of 32 bits.
    Sums do not depend on row order and are partial in the map tasks, so no
    task ever sees the list of all documents.
    """
    lanes = [
        F.sum(F.conv(F.substring("sha", 1 + 8 * lane, 8), 16, 10).cast("decimal(20,0)")).alias(f"lane{lane}")
        for lane in range(LANES)
    ]
    totals = hashes.agg(F.count(F.lit(1)).alias("n_docs"), *lanes)
    parts = [F.lit(settings), F.col("n_docs").cast("string")]
    parts += [F.coalesce(F.col(f"lane{lane}").cast("string"), F.lit("0")) for lane in range(LANES)]
    return totals.select("n_docs", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def corpus_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, change) for added, changed and removed documents between two hash tables."""
    both = old.withColumnRenamed("sha", "old_sha").join(new.withColumnRenamed("sha", "new_sha"), "doc_id", "full_outer")
    change = (
        F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").otherwise("changed")
    )
    return both.where(~F.col("old_sha").eqNullSafe(F.col("new_sha"))).select("doc_id", change.alias("change"))


def decision(current: DataFrame, saved: str) -> DataFrame:
    """(action, n_docs, fingerprint): skip when the fingerprint is the saved one; '' is no state."""
    action = F.when(F.col("fingerprint") == saved, "skipped").otherwise("reindexed")
    return current.select(action.alias("action"), F.col("n_docs").alias("tables_found"), "fingerprint")
