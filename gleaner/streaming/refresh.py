"""Incremental index refresh from a stream of document versions.

A file stream does not see files edited in place or removed, so it reads
immutable records: (doc_id, version, file_name, text, deleted). Each batch
takes the latest version per document, drops those older than what is known
(deletions included), and writes the rest. All that is told by hashes; texts
never move, those that changed are read once more where they are:

- `changes/batch=N`    doc_id, version, file_name, sha, deleted, effect, posted
- `postings/batch=N`   the counted words of changed documents
- `log/batch=N`        action and counts, as JSON

The live corpus is the newest change per document; its postings are those of
batch `posted`, the last that changed its text. `effect` is NULL where only the
version moved on, so that a late older version is still told. A batch repeated after a crash overwrites its own
folders, so nothing is counted twice. Text is tokenized only when it changed.
`live_index` makes the live corpus searchable without reading any text, and
`compact` carries only what is live over to a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.index import BUCKETS, Index, counted_words, read_index, write_index
from gleaner.operators.ordered import latest_rows
from gleaner.operators.snapshots import document_hash
from gleaner.session import broadcast_parts, read_if_there, write_table

VERSIONS = "doc_id long, version long, file_name string, text string, deleted boolean"
CHANGES = "doc_id long, version long, file_name string, sha string, deleted boolean, effect string, posted long, batch long"
POSTINGS = "doc_id long, dl long, term string, tf long, opens struct<file_name: string>, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table before the first batch wrote it."""
    found = read_if_there(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def newest_changes(spark: SparkSession, home: str, *, before: int | None = None) -> DataFrame:
    """The newest change of every document, deletions included."""
    changes = _read(spark, f"{home}/changes", CHANGES)
    if before is not None:
        changes = changes.where(F.col("batch") < before)
    kept = ["file_name", "version", "sha", "deleted", "posted", "batch"]
    return latest_rows(changes, ["doc_id"], ["version", "batch"], kept)


def live_documents(spark: SparkSession, home: str, *, before: int | None = None) -> DataFrame:
    """(doc_id, file_name, version, sha, posted, batch) of documents not deleted since."""
    return newest_changes(spark, home, before=before).where(~F.col("deleted")).drop("deleted")


def _live_words(spark: SparkSession, home: str) -> DataFrame:
    live = live_documents(spark, home).select("doc_id", F.col("posted").alias("batch"))
    return _read(spark, f"{home}/postings", POSTINGS).join(live, ["doc_id", "batch"], "left_semi")


def live_postings(spark: SparkSession, home: str) -> DataFrame:
    return _live_words(spark, home).where("term is not null").select("doc_id", "term", "tf", "dl")


def live_index(spark: SparkSession, home: str, *, buckets: int = BUCKETS) -> Index:
    """The live corpus as a searchable index, made of the posted words alone: the same tables
    as a full build over the live documents."""
    write_index(write_table(_live_words(spark, home).drop("batch"), "live"), f"{home}/search", buckets=buckets)
    return read_index(spark, f"{home}/search")


def compact(spark: SparkSession, home: str, target: str) -> None:
    """Write the newest change of each document and the live postings to the new folder `target`,
    with the batches they came from. Stop the stream first and go on with
    `refresh_stream(spark, source, target, checkpoint=f"{home}/checkpoint")`."""
    for name, rows in (("postings", _live_words(spark, home)), ("changes", newest_changes(spark, home))):
        rows.hint("rebalance").write.partitionBy("batch").parquet(f"{target}/{name}")


def _newest_rows(versions: DataFrame) -> DataFrame:
    """(doc_id, version, file_name, sha, deleted, n): the newest version of every document, which `n` rows deliver."""
    rows = versions.select("doc_id", "version", F.struct("file_name", document_hash().alias("sha"), "deleted").alias("row"))
    rows = rows.groupBy("doc_id", "version").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
    return latest_rows(rows.select("doc_id", "version", "row.*", "n"), ["doc_id"], ["version"], ["version", "file_name", "sha", "deleted", "n"])


def _texts(versions: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, file_name, text) of the versions in `wanted`, a broadcast; only rows that came several times move, to be one."""
    wanted = wanted.select(*[F.col(c).alias(f"wanted_{c}") for c in ("doc_id", "version", "sha")], "n")
    met = versions.join(wanted, (F.col("doc_id") == F.col("wanted_doc_id")) & F.col("version").eqNullSafe(F.col("wanted_version")))
    found = met.where("n = 1").select("doc_id", "file_name", "text")
    if not repeated:
        return found
    several = met.where((F.col("n") > 1) & (document_hash() == F.col("wanted_sha"))).select("doc_id", "file_name", "text")
    return found.unionByName(several.dropDuplicates(["doc_id"]))


def apply_versions(versions: DataFrame, batch: int, home: str) -> None:
    """One batch: find what it changes against all earlier batches, and write that."""
    spark = versions.sparkSession
    known = newest_changes(spark, home, before=batch).select(
        "doc_id",
        F.col("version").alias("known_version"),
        (~F.col("deleted")).alias("is_live"),
        F.when(~F.col("deleted"), F.col("sha")).alias("live_sha"),
        F.col("posted").alias("live_posted"),
    )
    compared = _newest_rows(versions).join(known, "doc_id", "left")
    is_new = F.col("known_version").isNull() | (F.col("version") > F.col("known_version"))
    effect = F.when(F.col("deleted"), F.when(F.col("is_live"), "removed")).otherwise(
        F.when(~F.col("sha").eqNullSafe(F.col("live_sha")), "changed")
    )
    changed = compared.where(is_new).withColumn("effect", effect)
    posted = F.when(F.col("effect") == "changed", F.lit(batch)).when(~F.col("deleted"), F.col("live_posted"))
    changed = changed.withColumn("posted", posted.cast("long"))
    # Written, so that the changes are worked out once.
    changed.select("doc_id", "version", "file_name", "sha", "deleted", "effect", "posted", "n").write.mode("overwrite").parquet(
        f"{home}/arrived/batch={batch}"
    )
    written = spark.read.parquet(f"{home}/arrived/batch={batch}")
    new_texts = written.where("effect = 'changed'").select("doc_id", "version", "sha", "n")
    repeated = not new_texts.where("n > 1").isEmpty()
    for at, part in enumerate(broadcast_parts(new_texts, "doc_id")):
        posted_words = counted_words(_texts(versions, part, repeated), unique=True)
        posted_words.write.mode("append" if at else "overwrite").parquet(f"{home}/postings/batch={batch}")
    # The changes go last: until they are there, the batch is not part of the live corpus.
    written.drop("n").write.mode("overwrite").parquet(f"{home}/changes/batch={batch}")
    tally = written.agg(
        F.count_if(F.col("effect") == "changed").alias("docs_changed"), F.count_if(F.col("effect") == "removed").alias("docs_removed")
    )
    total = live_documents(spark, home, before=batch + 1).select(F.count(F.lit(1))).scalar()
    action = F.when(F.col("docs_changed") + F.col("docs_removed") > 0, "reindexed").otherwise("skipped")
    tally.select(
        F.current_timestamp().cast("string").alias("timestamp"), action.alias("action"), "docs_changed", "docs_removed",
        total.alias("tables_found"),
    ).write.mode("overwrite").json(f"{home}/log/batch={batch}")


def refresh_stream(
    spark: SparkSession, source: str, home: str, *, every: str | None = None, files_per_batch: int = 1000, checkpoint: str | None = None
) -> StreamingQuery:
    """Follow a folder of version files: all that is there, once, or `every` interval. The
    stream's progress is kept in `checkpoint`, by default a folder of `home`."""
    reader = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_per_batch)
    versions = reader.parquet(source)
    writer = versions.writeStream.option("checkpointLocation", checkpoint or f"{home}/checkpoint").foreachBatch(
        lambda rows, batch: apply_versions(rows, batch, home)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
