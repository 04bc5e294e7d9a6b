"""Documents in a bounded number of container files, with a table of offsets, read whole or by name.

A file and folder per document costs the driver a commit and a listing entry each. Here documents
are dealt to containers of about `container_bytes` by hash of name and text, so equal names spread;
a container is one UTF-8 text file of its documents in order of (name, text), each followed by a line break.
`offsets` says for each document which container holds it, from which byte, and how many bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import write_table

CONTAINER_BYTES = 32 << 20
# Up to so many containers are named in the scan; for more of them the join alone decides.
NAMED_CONTAINERS = 1_000


def write_packed(docs: DataFrame, path: str, container_bytes: int = CONTAINER_BYTES) -> None:
    """Write (table_name, text). Repeated rows stay, a NULL name or text comes back as NULL, an empty text as empty.

    A text longer than a container is not split; its container is as long as that text.
    """
    sized = docs.select("table_name", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes"))
    # Sizes, offsets and containers all read the rows: they are made once.
    rows = write_table(sized, "unpacked")
    total = rows.agg(F.sum(F.col("_bytes") + 1)).first()[0] or 0
    containers = max(1, -(-total // container_bytes))
    dealt = rows.withColumn("container", F.pmod(F.xxhash64("table_name", "text"), F.lit(containers)).cast("string"))
    # Rows that tie are equal, so either order of them is that of the file.
    order = ["table_name", "text"]
    before = Window.partitionBy("container").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("_bytes") + 1).over(before), F.lit(0)).alias("first_byte")
    length = F.when(F.col("text").isNotNull(), F.col("_bytes")).alias("n_bytes")
    dealt.select("table_name", "container", at, length).write.parquet(f"{path}/offsets")
    tasks = min(containers, 20_000)
    placed = dealt.repartition(tasks, "container").sortWithinPartitions("container", *order)
    placed.select("container", "text").write.partitionBy("container").text(f"{path}/containers", lineSep="\n")


def read_packed(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """(table_name, text) of all documents, or of those whose name is in `names` (table_name), each once.
    A NULL name is asked for like any other. Only containers that hold one of them are read."""
    spans = spark.read.parquet(f"{path}/offsets")
    files = spark.read.schema("value string, container string").text(f"{path}/containers", wholetext=True)
    if names is not None:
        asked = names.select(F.col("table_name").alias("_asked")).distinct()
        spans = write_table(spans.join(asked, F.col("table_name").eqNullSafe(F.col("_asked")), "left_semi"), "spans")
        needed = [r.container for r in spans.select("container").distinct().limit(NAMED_CONTAINERS + 1).collect()]
        if len(needed) <= NAMED_CONTAINERS:
            files = files.where(F.col("container").isin(needed))
    # One row a container on both sides: a container's bytes are shuffled once, not once a document.
    held = spans.groupBy("container").agg(F.collect_list(F.struct("table_name", "first_byte", "n_bytes")).alias("spans"))
    whole = files.select("container", F.col("value").cast("binary").alias("bytes"))
    # Exploded before it is cut, a container's bytes are fetched once and not once a document.
    each = held.join(whole, "container").select("bytes", F.explode("spans").alias("span"))
    first, length = (F.col("span.first_byte") + 1).cast("int"), F.col("span.n_bytes").cast("int")
    return each.select("span.table_name", F.substring("bytes", first, length).cast("string").alias("text"))
