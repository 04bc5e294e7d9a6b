"""What several training-data operators share: row keys, held-out folds, links to components."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.session import write_table

# `[\x20\x09-\x0D]+`, the separators of words in the contracts.
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
# `[^\x20\x09-\x0D]`, a character of a word.
NON_BLANK = "[^ \\t\\n\\x0B\\f\\r]"
# Narrow rows of one sorted range.
RANGE_ROWS = 1_000_000

# Tasks get this module's functions with the job; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def text_digest(text: Column) -> Column:
    """With doc_id, the identity of a row: rows that agree in both are one document."""
    return F.xxhash64(text)


def in_fold(doc_id: Column, divisor: int, fold: int) -> Column:
    """crc32 of the id as text, modulo `divisor`, is `fold`; a NULL id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == fold, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to one row (node, root) per linked node; root is the smallest node it reaches.

    Every round each node takes the smallest root among its neighbours and then
    the root of that root, so paths shorten by more than half. Rounds are written
    to the shared folder; a hub meets plain shuffles that adaptive execution splits.
    """
    pairs = links.where("a <> b").select("a", "b")
    both = write_table(pairs.union(pairs.select("b", "a")), "links")
    roots = write_table(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "roots"
    )
    while True:
        heard = (
            both.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        )
        near = roots.join(heard, "node").select("node", "root", F.least("root", "heard").alias("near"))
        above = roots.select(F.col("node").alias("near"), F.col("root").alias("far"))
        found = near.join(above, "near").select(
            "node", F.least("near", "far").alias("root"), (F.least("near", "far") < F.col("root")).alias("moved")
        )
        found = write_table(found, "roots")
        roots = found.select("node", "root")
        if found.where("moved").isEmpty():
            return roots


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds `out`: the place of each row in the order of the whole table, from 0, without a single-task
    sort: range partitions are counted, then numbered within. The written table fixes the ranges."""
    ranged = write_table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, however many rows there are.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + within - 1).drop("_part", "_start")


def running(rows: DataFrame, key: str, chunk: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds `sums`: new columns, each the sum of a column over a row and all rows before it within `key`.

    `chunk` must not decrease along `order`. Windows run per (key, chunk) and one row per chunk carries
    the totals on, so a key with a third of all rows is many windows. A NULL key is a key like any other.
    """
    totals = rows.groupBy(key, chunk).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(key).alias("_key"), F.col(chunk).alias("_chunk"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_carried_{n}") for n in sums]
    )
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col(chunk) == F.col("_chunk")))
    summed = {name: F.sum(value).over(within) + F.col(f"_carried_{name}") for name, value in sums.items()}
    return joined.withColumns(summed).drop("_key", "_chunk", *[f"_carried_{n}" for n in sums])


def in_order(rows: DataFrame, key: str, order: list[str], weight: str) -> DataFrame:
    """Adds `pos`, a row's place from 0 within its key, and `before`, the sum of `weight` over the key's earlier rows.

    Rows meet in ranges of (key, order) that the written table fixes; the number of ranges follows the number of rows.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()).withColumn("_one", F.lit(1))
    summed = running(write_table(ranged, "ranged"), key, "_part", order, {"pos": "_one", "before": weight})
    return summed.withColumns({"pos": F.col("pos") - 1, "before": F.col("before") - F.col(weight)}).drop("_part", "_one")


def digest_of_pieces(pieces: DataFrame, keys: list[str], separator: str) -> DataFrame:
    """(keys, sha256): SHA-256 in lowercase hex of each key's pieces joined in order, of (keys, no, piece) with pieces of bounded size.

    SHA-256 has to see its bytes in turn. Keys of one piece are hashed where they are; the others' pieces pass
    sorted through one task a key, a piece at a time, so no task holds more than a batch of them.
    """
    counted = pieces.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    one = counted.where("_n = 1").select(*keys, F.sha2("piece", 256).alias("sha256"))
    many = counted.where("_n > 1").select(*keys, "no", "piece").repartition(*keys).sortWithinPartitions(*keys, "no")

    schema, types = one.schema, to_arrow_schema(one.schema).types

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for *key, _, piece in zip(*(column.to_pylist() for column in batch.columns)):
                if key != last:
                    out += [(*last, state.hexdigest())] if state else []
                    last, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update((separator + piece).encode())
            yield done(out)
        yield done([(*last, state.hexdigest())] if state else [])

    def done(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return one.unionByName(many.mapInArrow(stream, schema))
