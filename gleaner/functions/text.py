"""Text column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (`trim` removes blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(F.rlike(text, F.lit(r"\S")), F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def first_fenced_block(reply: Column) -> Column:
    """Content of the first fenced block, with or without a `sql` tag; '' without one."""
    return F.coalesce(strip(F.regexp_extract(reply, r"(?is)```(?:sql)?\s*\n?(.*?)```", 1)), F.lit(""))


def plain_quotes(text: Column) -> Column:
    """Lower case with typographic apostrophes made straight."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), "’‘", "''")


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(text, F.lit(phrase))
    return found


def quoted_list(names: Column) -> Column:
    """['a', 'b'] for an array of names."""
    return F.when(F.size(names) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    )


def token_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that occur in the text."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)
    )


def unnest(rows: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element. From a plain explode the planner derives a filter that
    the array is not empty, and evaluates a costly array once more below the scan for it;
    the outer form with a NULL test has the same rows without that."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
