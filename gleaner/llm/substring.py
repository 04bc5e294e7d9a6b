"""Substring dedup by hashing units: sentences and lines of a text, with their offsets.

Units are normalised (lower case, single blanks) and named by two hashes. Of each name the
occurrence earliest by (doc_id, text digest, place) stays. Later occurrences that follow one
another and have `min_words` words together are removed; shorter ones are common phrases and stay.
Offsets are code points of the original text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, text_digest
from gleaner.session import write_table

MIN_WORDS = 20
# After a line break, and between the end of a sentence and a blank; no character is lost.
BOUNDARY = "(?<=\\n)|(?<=[.!?])(?=[ \\t])"
ROW = ("doc_id", "digest")


def _units(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, at, start, stop, words, one, two): non-blank units; `at` counts them."""
    split = documents.select("doc_id", text_digest(F.col("text")).alias("digest"), F.posexplode(F.split("text", BOUNDARY)).alias("pos", "unit"))
    plain = F.btrim(F.regexp_replace(F.lower("unit"), BLANKS, " "))
    named = split.select(*ROW, "pos", F.length("unit").alias("n"), plain.alias("plain"))
    hashed = named.select(
        *ROW, "pos", "n", F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " "))).alias("words"),
        F.xxhash64("plain").alias("one"), F.xxhash64(F.lit(1), "plain").alias("two"),
    )
    in_order = Window.partitionBy(*ROW).orderBy("pos")
    # Repeated rows give the same unit twice; one of them speaks for both.
    placed = hashed.dropDuplicates([*ROW, "pos"]).withColumn("stop", F.sum("n").over(in_order))
    full = placed.where("words > 0").withColumn("at", F.row_number().over(in_order))
    return full.select(*ROW, "at", (F.col("stop") - F.col("n")).alias("start"), "stop", "words", "one", "two")


def repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, spans): for documents that lose text, the (start, stop) removed, in order.

    NULL and blank texts lose nothing. A NULL doc_id is the earliest. Rows equal in doc_id and
    text are one document: they lose the same spans and are no copies of each other.
    """
    units = write_table(_units(documents), "units")
    place = F.struct(*ROW, "at")
    first = units.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = units.join(write_table(first, "first"), ["one", "two"]).where(place > F.col("first"))
    island = F.col("at") - F.row_number().over(Window.partitionBy(*ROW).orderBy("at"))
    runs = later.withColumn("island", island).groupBy(*ROW, "island").agg(
        F.sum("words").alias("words"), F.struct(F.min("start").alias("start"), F.max("stop").alias("stop")).alias("span")
    )
    spans = runs.where(F.col("words") >= min_words).groupBy(*ROW).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return write_table(spans, "spans")


def _joined(documents: DataFrame, spans: DataFrame, digest: Column) -> DataFrame:
    gone = spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), F.col("spans").alias("_spans"))
    marked = documents.withColumn("_digest", digest)
    return marked.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")


def without_repeats(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents' own rows and columns, `text` without the removed spans."""
    found = _joined(documents, repeats(documents, min_words), text_digest(F.col("text")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    gaps = F.zip_with(ends, starts, lambda a, b: F.substr(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(gaps, ""))
    return found.withColumn("text", text).select(*documents.columns)


def op3_substring(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), text_digest(F.col("text")).alias("_d"))
    found = _joined(rows, repeats(documents), F.col("_d"))
    spans = F.coalesce(F.transform("_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), F.array().cast("array<string>"))
    removed = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]), F.lit(0))
    return found.select("doc_id", "n_chars", removed.cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed"))
