"""A refresh cycle over a whole corpus: fingerprint, compare, rebuild or skip, log."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import index, snapshots
from gleaner.session import read_if_there
from gleaner.sources.sinks import append_log


def load_state(spark: SparkSession, path: str) -> str:
    """The last saved fingerprint; '' before the first one."""
    states = read_if_there(spark, f"{path}/state")
    if states is None:
        return ""
    newest = states.agg(F.max_by("fingerprint", "saved_at").alias("fingerprint")).first()
    return newest.fingerprint or ""


def save_state(spark: SparkSession, path: str, fingerprint: str) -> None:
    """Append, never overwrite: a crash leaves the older state readable."""
    spark.range(1).select(F.lit(fingerprint).alias("fingerprint"), F.current_timestamp().alias("saved_at")).write.mode(
        "append"
    ).parquet(f"{path}/state")


def log_refresh(spark: SparkSession, path: str, action: str, tables_found: int, duration_ms: int) -> None:
    record = spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        F.lit(action).alias("action"),
        F.lit(tables_found).cast("long").alias("tables_found"),
        F.lit(duration_ms).cast("long").alias("duration_ms"),
    )
    append_log(record, f"{path}/refresh_log")


def run_cycle(docs: DataFrame, path: str, *, settings: str = "") -> str:
    """'reindexed' or 'skipped'. The state is saved only after a complete build, so a
    failed cycle is tried again by the next one."""
    spark, started = docs.sparkSession, time.monotonic()
    current = snapshots.fingerprint(snapshots.document_hashes(docs), settings)
    found = snapshots.decision(current, load_state(spark, path)).first()
    if found.action == "reindexed":
        index.build_index(docs, f"{path}/index")
        save_state(spark, path, found.fingerprint)
    log_refresh(spark, path, found.action, found.tables_found, int((time.monotonic() - started) * 1000))
    return found.action
