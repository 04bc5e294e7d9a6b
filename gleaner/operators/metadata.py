"""Catalog metadata to one Markdown document per table, and back to a catalog.

Inputs have the shape of a database's information schema, for a whole schema at once:

- tables       table_schema, table_name, table_type, object_id
- columns      table_schema, table_name, ordinal, column_name, data_type, max_length,
               num_precision, num_scale, is_nullable
- properties   major_id, minor_id, class, name, value
- constraints  constraint_name, table_schema, constraint_type
- key_usage    constraint_name, table_schema, table_name, ordinal, column_name
- fks          fk_id, table_schema, table_name
- fk_columns   fk_id, column_name, ref_table, ref_column

A table has a bounded number of columns and keys, so each document is built
from a small ordered group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.fixed import (
    NAMING_NOTE,
    NO_DESCRIPTION,
    NO_FOREIGN_KEYS,
    NO_PRIMARY_KEY,
    NO_SUBJECT_AREA,
)
from gleaner.functions.text import lines, strip


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Read-only metadata source: the query runs at the server, the result arrives as rows."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def _descriptions(properties: DataFrame) -> DataFrame:
    kept = properties.where((F.col("class") == 1) & (F.col("name") == "MS_Description"))
    return kept.select("major_id", "minor_id", F.col("value").alias("description"))


def described_tables(tables: DataFrame, properties: DataFrame, schema: str) -> DataFrame:
    """Base tables of one schema, each with its description or NULL."""
    notes = _descriptions(properties).where(F.col("minor_id") == 0).select(F.col("major_id").alias("object_id"), "description")
    kept = tables.where((F.col("table_type") == "BASE TABLE") & (F.col("table_schema") == schema))
    return kept.join(notes, "object_id", "left").select("object_id", "table_name", "description")


def described_columns(tables: DataFrame, columns: DataFrame, properties: DataFrame, schema: str) -> DataFrame:
    """All columns of one schema with their descriptions, found by (object, ordinal)."""
    objects = tables.where(F.col("table_schema") == schema).select("table_name", "object_id")
    notes = _descriptions(properties).select(
        F.col("major_id").alias("object_id"), F.col("minor_id").alias("ordinal"), "description"
    )
    kept = columns.where(F.col("table_schema") == schema).join(objects, "table_name")
    return kept.join(notes, ["object_id", "ordinal"], "left")


def primary_keys(constraints: DataFrame, key_usage: DataFrame, schema: str) -> DataFrame:
    """(table_name, primary_key): key columns in ordinal order, joined by commas."""
    kept = constraints.where((F.col("constraint_type") == "PRIMARY KEY") & (F.col("table_schema") == schema))
    used = kept.select("constraint_name", "table_schema").join(key_usage, ["constraint_name", "table_schema"])
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "column_name")))
    return used.groupBy("table_name").agg(F.array_join(ordered["column_name"], ", ").alias("primary_key"))


def foreign_keys(fks: DataFrame, fk_columns: DataFrame, schema: str) -> DataFrame:
    """(table_name, column_name, ref_table, ref_column)."""
    kept = fks.where(F.col("table_schema") == schema).select("fk_id", "table_name")
    return kept.join(fk_columns, "fk_id").select("table_name", "column_name", "ref_table", "ref_column")


def type_text() -> Column:
    """A length wins over precision and scale; -1 is MAX; 0 is no length."""
    base, length = F.upper("data_type"), F.coalesce("max_length", F.lit(0))
    size = F.when(length == -1, "MAX").otherwise(length.cast("string"))
    both = F.col("num_precision").isNotNull() & F.col("num_scale").isNotNull()
    digits = F.concat_ws(",", F.col("num_precision").cast("string"), F.col("num_scale").cast("string"))
    return (
        F.when(length != 0, F.concat(base, F.lit("("), size, F.lit(")")))
        .when(both, F.concat(base, F.lit("("), digits, F.lit(")")))
        .otherwise(base)
    )


def _or_placeholder(text: Column, placeholder: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(placeholder))


def render_documents(tables: DataFrame, columns: DataFrame, keys: DataFrame, fks: DataFrame) -> DataFrame:
    """(table_name, text) from the results of the four functions above."""
    nullable = F.when(F.col("is_nullable") == "NO", "NOT NULL").otherwise("NULL")
    row = F.concat(
        F.lit("| "), F.col("column_name"), F.lit(" | "), type_text(), F.lit(" | "), nullable, F.lit(" | "),
        _or_placeholder(F.col("description"), NO_DESCRIPTION), F.lit(" | — |"),
    )
    rows = columns.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row"))))["row"].alias("rows")
    )
    link = F.concat(
        F.lit("- `"), F.col("column_name"), F.lit("` → `"), F.col("ref_table"), F.lit("."), F.col("ref_column"), F.lit("`")
    )
    links = fks.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("column_name", link.alias("link"))))["link"].alias("links")
    )
    joined = tables.join(rows, "table_name", "left").join(keys, "table_name", "left").join(links, "table_name", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(
        F.array(
            F.concat(F.lit("# TABLE: "), F.col("table_name")),
            F.lit(""),
            F.lit(f"**Subject area:** {NO_SUBJECT_AREA}"),
            F.concat(F.lit("**Purpose:** "), _or_placeholder(F.col("description"), NO_DESCRIPTION)),
            F.lit(""),
            F.lit("## Columns"),
            F.lit(""),
            F.lit("| Column | Type | Nullable | Description | Example |"),
            F.lit("|---|---|---|---|---|"),
        ),
        F.coalesce("rows", none),
        F.array(
            F.lit(""),
            F.lit("## Primary key"),
            F.coalesce("primary_key", F.lit(NO_PRIMARY_KEY)),
            F.lit(""),
            F.lit("## Foreign keys / relationships"),
        ),
        F.coalesce("links", F.array(F.lit(NO_FOREIGN_KEYS))),
        F.array(F.lit(""), F.lit("## Naming conventions"), F.lit(NAMING_NOTE), F.lit("")),
    )
    return joined.select("table_name", F.array_join(parts, "\n").alias("text"))


def documentation_gaps(docs: DataFrame) -> DataFrame:
    """(table_name, n_gaps): how often a document carries the placeholder."""
    placeholder = F.lit(NO_DESCRIPTION)
    n_gaps = F.size(F.split(F.col("text"), f"\\Q{NO_DESCRIPTION}\\E")) - 1
    return docs.where(F.contains("text", placeholder)).select("table_name", n_gaps.cast("long").alias("n_gaps"))


def parse_catalog(docs: DataFrame) -> DataFrame:
    """(table, column, type) from the `## Columns` sections of (table_name, text).

    The header is told by its first two cells, so a column named `description`
    stays. A name given twice keeps its last type. Each document is cut into
    sections and rows in place; nothing is shuffled but the result.
    """
    opened = F.concat(F.lit("\n"), F.array_join(lines(F.col("text")), "\n"))
    sections = F.filter(
        F.split(opened, r"\n\s*(?=## )"), lambda s: F.rlike(s, F.lit(r"(?i)^## columns[ \t]*(\n|$)"))
    )
    rows = F.split(F.array_join(sections, "\n"), "\n")
    found = docs.select(F.lower("table_name").alias("table"), F.posexplode(rows).alias("at", "row"))
    cell = r"^\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|"
    cells = found.select(
        "table", "at", strip(F.regexp_extract("row", cell, 1)).alias("name"), strip(F.regexp_extract("row", cell, 2)).alias("type")
    )
    is_header = (F.lower("name") == "column") & (F.lower("type") == "type")
    kept = cells.where(F.rlike("name", F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$")) & ~is_header)
    return kept.groupBy("table", F.lower("name").alias("column")).agg(F.max_by("type", "at").alias("type"))


def column_tables(catalog: DataFrame) -> DataFrame:
    """(column, table, n_tables): the inverted catalog as rows. A name such as `id` may be in
    most tables, so the tables of a column are not collected into one list."""
    rows = catalog.select("column", "table").distinct()
    return rows.join(rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_tables")), "column")
