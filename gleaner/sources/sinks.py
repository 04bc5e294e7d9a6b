"""File sinks and sources: query log, refresh log, text documents, question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank

QUESTION_SET = "question_no long, question string, expected_tables array<string>, expected_columns array<string>, notes string"


def append_log(records: DataFrame, path: str) -> None:
    """Append JSON lines; nulls are written out, and bulky `raw_chunks` are left off."""
    records.drop("raw_chunks").write.mode("append").option("ignoreNullFields", "false").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """(line_no, line) as text. The sort is by range, so the files in name order are the report."""
    lines.orderBy("line_no").select("line").write.text(path)


def read_question_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; a missing list is an empty one."""
    rows = spark.read.schema(QUESTION_SET).json(path)
    none = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("expected_tables", "expected_columns")})


def write_text_documents(docs: DataFrame, path: str) -> None:
    """One text folder per table. Rows are first grouped by name, so that a folder gets one
    file and each task writes only its own tables' files."""
    docs.repartition("table_name").select("table_name", "text").write.partitionBy("table_name").text(path, lineSep="\n")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, text) from such folders; the writer's closing line break is not part of a text."""
    files = spark.read.schema("value string, table_name string").text(path, wholetext=True)
    return files.select("table_name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text): every file read whole, blank ones dropped. Whole texts are
    returned whatever their length; nothing is split."""
    files = spark.read.text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return named.where(~is_blank(F.col("text")))
