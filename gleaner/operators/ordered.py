"""Latest rows, running totals and neighbouring rows per entity, safe for hot entities.

A window over one entity sorts all its rows in one task. Two other ways are used:

- The latest row is an aggregate (`max_by` over the sort key): partial results
  are made in the map tasks, and one row per entity and task is shuffled.
- A running total or neighbour cuts an entity's rows into time chunks. Windows
  run per (entity, chunk); one small row per (entity, chunk) carries totals
  or edge values across chunks. The result is that of the single window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the one with the greatest (order...) values; the last of
    `order` should be unique so that ties cannot occur."""
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def running_total(
    rows: DataFrame, key: str, order: list[str], value: str, *, chunk: Column, name: str = "balance"
) -> DataFrame:
    """Adds the sum of `value` up to and including each row. `chunk` must not
    decrease along `order`; a date or hour of the ordering time is typical."""
    cut = rows.withColumn("_chunk", chunk)
    totals = cut.groupBy(key, "_chunk").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_chunk", F.sum("_total").over(before).alias("_carried"))
    within = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(rows.schema[value].dataType)
    # As in a single window, a row has no total while all values up to it are NULL.
    summed = F.when(
        F.col("_carried").isNotNull() | F.col("_within").isNotNull(),
        F.coalesce("_carried", zero) + F.coalesce("_within", zero),
    )
    joined = cut.join(carried, [key, "_chunk"]).withColumn("_within", F.sum(value).over(within))
    return joined.withColumn(name, summed).drop("_chunk", "_carried", "_within")


def neighbours(
    rows: DataFrame,
    key: str,
    order: list[str],
    *,
    chunk: Column,
    following: dict[str, str] | None = None,
    preceding: dict[str, str] | None = None,
) -> DataFrame:
    """Adds columns of the next and the previous row of the same key: `following`
    and `preceding` map new column names to the columns they are read from."""
    following, preceding = following or {}, preceding or {}
    cut = rows.withColumn("_chunk", chunk)
    place = F.struct(*order)
    edges = []
    if following:
        edges.append(F.min_by(F.struct(*set(following.values())), place).alias("_first"))
    if preceding:
        edges.append(F.max_by(F.struct(*set(preceding.values())), place).alias("_last"))
    chunks = Window.partitionBy(key).orderBy("_chunk")
    ends = cut.groupBy(key, "_chunk").agg(*edges)
    beyond = [key, "_chunk"]
    if following:
        beyond.append(F.lead("_first").over(chunks).alias("_after"))
    if preceding:
        beyond.append(F.lag("_last").over(chunks).alias("_before"))
    within = Window.partitionBy(key, "_chunk").orderBy(*order)
    joined = cut.join(ends.select(*beyond), [key, "_chunk"]).withColumn("_row", F.row_number().over(within))
    # An edge row is told by its place, so a NULL inside a chunk stays a NULL.
    count = F.count(F.lit(1)).over(Window.partitionBy(key, "_chunk"))
    joined = joined.withColumn("_rows", count)
    for name, source in following.items():
        inside = F.lead(source).over(within)
        joined = joined.withColumn(name, F.when(F.col("_row") < F.col("_rows"), inside).otherwise(F.col(f"_after.{source}")))
    for name, source in preceding.items():
        inside = F.lag(source).over(within)
        joined = joined.withColumn(name, F.when(F.col("_row") > 1, inside).otherwise(F.col(f"_before.{source}")))
    return joined.drop("_chunk", "_row", "_rows", "_after", "_before")
