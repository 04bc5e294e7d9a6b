"""Reusable relational shapes that take any tables; dates are always arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.ordered import latest_rows, neighbours
from gleaner.session import write_table

MONEY = "decimal(15,2)"


def balance_as_of(rows: DataFrame, key: str, when: str, tiebreak: str, value: str, cutoff: Column) -> DataFrame:
    """(key, tiebreak, balance): each key's last row at or before the cutoff and the sum up to it.
    The cutoff reaches the scan, and both are partial in the map tasks: no window, no sort."""
    last = F.max_by(tiebreak, F.struct(when, tiebreak)).alias(tiebreak)
    return rows.where(F.col(when) <= cutoff).groupBy(key).agg(last, F.sum(value).alias("balance"))


def period_change(rows: DataFrame, entity: str, when: str, tiebreak: str, value: str) -> DataFrame:
    """(entity, period_end, value, change): month-end closing values, and the change to
    the entity's previous month with rows. A window sees one row per entity and month."""
    months = rows.withColumn("period_end", F.last_day(F.to_date(when)))
    closing = latest_rows(months, [entity, "period_end"], [when, tiebreak], [value])
    before = F.lag(value).over(Window.partitionBy(entity).orderBy("period_end"))
    return closing.select(entity, "period_end", value, (F.col(value) - before).alias("change"))


def with_child_totals(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, *totals: Column) -> DataFrame:
    """Left join of parents to child aggregates at the parents' grain: no parent row repeats."""
    grouped = children.groupBy(F.col(child_key).alias(parent_key)).agg(*totals)
    return parents.join(grouped, parent_key, "left")


def validity_history(rows: DataFrame, entity: str, when: str, tiebreak: str, state: str, *, chunk: Column) -> DataFrame:
    """(entity, tiebreak, effective, ended, state): every row holds until the entity's next one."""
    renamed = rows.select(entity, tiebreak, F.col(when).alias("effective"), F.col(state).alias("state"))
    return neighbours(renamed, entity, ["effective", tiebreak], chunk=chunk, following={"ended": "effective"})


def current_rows(history: DataFrame) -> DataFrame:
    return history.where(F.col("ended").isNull())


def current_states(rows: DataFrame, entity: str, when: str, tiebreak: str, state: str) -> DataFrame:
    """(entity, tiebreak, effective, state): the current rows of `validity_history`, by one aggregate
    instead of the whole history."""
    renamed = rows.select(entity, tiebreak, F.col(when).alias("effective"), F.col(state).alias("state"))
    return latest_rows(renamed, [entity], ["effective", tiebreak], [tiebreak, "effective", "state"])


def age_bucket(days: Column) -> Column:
    return (
        F.when(days <= 0, "0")
        .when(days < 30, "1-29")
        .when(days < 60, "30-59")
        .when(days < 90, "60-89")
        .otherwise("90+")
    )


def reconcile(parents: DataFrame, key: str, expected: Column, children: DataFrame, child_key: str, amount: Column, tolerance: Column) -> DataFrame:
    """Parents whose child sum is further from `expected` than the tolerance; no child sums to 0."""
    sums = children.groupBy(F.col(child_key).alias(key)).agg(F.sum(amount).alias("child_sum"))
    both = parents.withColumn("expected", expected).join(sums, key, "left")
    both = both.withColumn("child_sum", F.coalesce("child_sum", F.lit(0).cast(MONEY)))
    return both.where(F.abs(F.col("expected") - F.col("child_sum")) > tolerance)


def share_of_total(rows: DataFrame, key: str, value: Column, *, name: str = "share") -> DataFrame:
    """Adds each row's share of its key's total. Totals are grouped and joined back
    rather than windowed: a window would bring a hot key's rows to one task, while
    the join can split them, as the totals are written first and both sides are
    plain shuffles. The share of a total of 0 is NULL."""
    totals = write_table(rows.groupBy(key).agg(F.sum(value).alias("_total")), "totals")
    return rows.join(totals, key).withColumn(name, F.try_divide(value, F.col("_total"))).drop("_total")
