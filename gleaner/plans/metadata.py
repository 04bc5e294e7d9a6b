"""Registered metadata queries.

The information schema is derived from the parts: every part stands for a
table with 4 to 12 columns, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.fixed import NO_DESCRIPTION
from gleaner.operators import metadata
from gleaner.plans.fixtures import text_literal
from gleaner.sources.packed import read_packed, write_packed
from gleaner.sources.tables import Tables, spread
from gleaner.session import new_folder

SCHEMA = "dbo"


class InformationSchema:
    def __init__(self, spark, folder):
        part = spread(Tables(spark, folder).part.select("p_partkey", "p_name", "p_size"), "p_partkey")
        key = F.col("p_partkey")
        name = F.concat(F.lit("part_"), key.cast("string"))
        base = part.select(
            key.alias("object_id"), name.alias("table_name"),
            F.when(key % 5 == 4, "stg").otherwise(SCHEMA).alias("table_schema"),
            F.when(key % 11 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"),
            "p_name", (4 + F.col("p_size") % 9).alias("n_columns"),
        )
        self.tables = base.select("object_id", "table_name", "table_schema", "table_type")
        each = base.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col("n_columns"))))
        kind = (F.col("object_id") + F.col("ordinal")) % 5
        self.columns = each.select(
            "table_schema", "table_name", "ordinal",
            F.concat(F.lit("col_"), F.col("ordinal").cast("string")).alias("column_name"),
            F.when(kind == 0, "varchar").when(kind == 1, "nvarchar").when(kind == 2, "decimal").when(kind == 3, "int").otherwise("date").alias("data_type"),
            F.when(kind == 0, 10 * F.col("ordinal")).when(kind == 1, -1).when(kind == 3, 0).cast("int").alias("max_length"),
            F.when(kind == 2, 15).cast("int").alias("num_precision"),
            F.when(kind == 2, 2).cast("int").alias("num_scale"),
            F.when(F.col("ordinal") <= 2, "NO").otherwise("YES").alias("is_nullable"),
        )
        described = F.when(F.col("object_id") % 4 == 1, "").otherwise(F.concat(F.lit("Stock of "), F.col("p_name")))
        notes = base.where(F.col("object_id") % 3 != 0).select(
            F.col("object_id").alias("major_id"), F.lit(0).alias("minor_id"), described.alias("value"),
            F.lit(1).alias("class"), F.lit("MS_Description").alias("name"),
        )
        column_notes = each.where(F.col("ordinal") % 2 == 1).select(
            F.col("object_id").alias("major_id"), F.col("ordinal").alias("minor_id"),
            F.concat(F.lit("Column "), F.col("ordinal").cast("string"), F.lit(" of "), F.col("p_name")).alias("value"),
            F.when(F.col("ordinal") == 3, 7).otherwise(1).alias("class"),
            F.when(F.col("ordinal") == 5, "Caption").otherwise("MS_Description").alias("name"),
        )
        self.properties = notes.unionByName(column_notes)
        constraint = F.concat(F.lit("PK_"), F.col("table_name"))
        keyed = base.where(F.col("object_id") % 7 != 0)
        self.constraints = keyed.select(
            constraint.alias("constraint_name"), "table_schema",
            F.when(F.col("object_id") % 13 == 0, "UNIQUE").otherwise("PRIMARY KEY").alias("constraint_type"),
        )
        self.key_usage = keyed.select(
            constraint.alias("constraint_name"), "table_schema", "table_name",
            F.explode(F.when(F.col("object_id") % 2 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("at"),
        ).select(
            "constraint_name", "table_schema", "table_name", (3 - F.col("at")).alias("ordinal"),
            F.concat(F.lit("col_"), F.col("at").cast("string")).alias("column_name"),
        )
        linked = base.where(F.col("object_id") % 4 == 0)
        self.fks = linked.select(F.col("object_id").alias("fk_id"), "table_schema", "table_name")
        self.fk_columns = linked.select(
            F.col("object_id").alias("fk_id"), F.explode(F.array(F.lit(3), F.lit(2))).alias("at"),
            F.concat(F.lit("part_"), F.floor(F.col("object_id") / 2).cast("string")).alias("ref_table"),
        ).select(
            "fk_id", F.concat(F.lit("col_"), F.col("at").cast("string")).alias("column_name"), "ref_table",
            F.concat(F.lit("col_"), (F.col("at") - 1).cast("string")).alias("ref_column"),
        )

    def described_tables(self):
        return metadata.described_tables(self.tables, self.properties, SCHEMA)

    def described_columns(self):
        return metadata.described_columns(self.tables, self.columns, self.properties, SCHEMA)

    def primary_keys(self):
        return metadata.primary_keys(self.constraints, self.key_usage, SCHEMA)

    def foreign_keys(self):
        return metadata.foreign_keys(self.fks, self.fk_columns, SCHEMA)

    def documents(self):
        return metadata.render_documents(
            self.described_tables(), self.described_columns(), self.primary_keys(), self.foreign_keys()
        )


def meta_tables(spark, folder):
    return InformationSchema(spark, folder).described_tables().select("table_name", "description")


def meta_columns(spark, folder):
    rows = InformationSchema(spark, folder).described_columns()
    return rows.select("table_name", F.col("ordinal").cast("long").alias("ordinal"), "column_name", "data_type", "is_nullable", "description")


def meta_pk(spark, folder):
    return InformationSchema(spark, folder).primary_keys()


def meta_fk(spark, folder):
    return InformationSchema(spark, folder).foreign_keys()


def meta_fmt_type(spark, folder):
    rows = InformationSchema(spark, folder).columns
    return rows.select("table_name", "column_name", metadata.type_text().alias("type"))


def meta_render_doc(spark, folder):
    return InformationSchema(spark, folder).documents()


def meta_doc_gaps(spark, folder):
    return metadata.documentation_gaps(InformationSchema(spark, folder).documents())


def doc_sink(spark, folder):
    """Documents written into container files and read back whole."""
    path = new_folder(spark, "documents")
    write_packed(InformationSchema(spark, folder).documents(), path)
    return read_packed(spark, path)


def doc_lookup(spark, folder):
    """Documents of every twentieth part read by name from the containers."""
    path = new_folder(spark, "documents")
    write_packed(InformationSchema(spark, folder).documents(), path)
    part = Tables(spark, folder).part.where("p_partkey % 20 = 0")
    return read_packed(spark, path, part.select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table_name")))


def catalog_columns(spark, folder):
    return metadata.parse_catalog(InformationSchema(spark, folder).documents())


def column_tables(spark, folder):
    return metadata.column_tables(catalog_columns(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        meta_tables, meta_columns, meta_pk, meta_fk, meta_fmt_type, meta_render_doc, meta_doc_gaps, doc_sink,
        doc_lookup, catalog_columns, column_tables,
    )
}

_GAP = text_literal(NO_DESCRIPTION)
_META = f"""WITH base AS (
  SELECT p_partkey AS id, 'part_' || p_partkey AS table_name, p_partkey % 5 <> 4 AS is_dbo, p_partkey % 11 <> 0 AS is_table,
    p_name, 4 + p_size % 9 AS n FROM part
), tabs AS (
  SELECT id, table_name, p_name,
    CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 4 = 1 THEN '' ELSE 'Stock of ' || p_name END END AS description
  FROM base WHERE is_dbo AND is_table
), every_col AS (
  SELECT *, 'col_' || ordinal AS column_name, (id + ordinal) % 5 AS kind FROM (SELECT *, unnest(range(1, n + 1)) AS ordinal FROM base)
), typed AS (
  SELECT *, CASE kind WHEN 0 THEN 'varchar' WHEN 1 THEN 'nvarchar' WHEN 2 THEN 'decimal' WHEN 3 THEN 'int' ELSE 'date' END AS data_type,
    CASE kind WHEN 0 THEN 'VARCHAR(' || 10 * ordinal || ')' WHEN 1 THEN 'NVARCHAR(MAX)' WHEN 2 THEN 'DECIMAL(15,2)'
      WHEN 3 THEN 'INT' ELSE 'DATE' END AS type,
    CASE WHEN ordinal <= 2 THEN 'NO' ELSE 'YES' END AS is_nullable,
    CASE WHEN ordinal % 2 = 1 AND ordinal NOT IN (3, 5) THEN 'Column ' || ordinal || ' of ' || p_name END AS description
  FROM every_col
), cols AS (SELECT * FROM typed WHERE is_dbo),
pks AS (
  SELECT table_name, CASE WHEN id % 2 = 0 THEN 'col_2, col_1' ELSE 'col_1' END AS primary_key
  FROM base WHERE is_dbo AND id % 7 <> 0 AND id % 13 <> 0
), fks AS (
  SELECT table_name, 'col_' || a AS column_name, 'part_' || (id // 2) AS ref_table, 'col_' || (a - 1) AS ref_column
  FROM (SELECT *, unnest([3, 2]) AS a FROM base WHERE is_dbo AND id % 4 = 0)
), docs AS (
  SELECT t.table_name, concat_ws(chr(10), '# TABLE: ' || t.table_name, '', '**Subject area:** <!-- TODO: classify subject area -->',
    '**Purpose:** ' || coalesce(nullif(t.description, ''), {_GAP}), '', '## Columns', '',
    '| Column | Type | Nullable | Description | Example |', '|---|---|---|---|---|', c.rows, '', '## Primary key',
    coalesce(primary_key, '<!-- TODO: no primary key found -->'), '', '## Foreign keys / relationships',
    coalesce(f.links, '*(none)*'), '', '## Naming conventions', '*(add any table-level naming conventions here)*', '') AS text,
    c.n_missing + CASE WHEN coalesce(t.description, '') = '' THEN 1 ELSE 0 END AS n_gaps
  FROM tabs t JOIN (
    SELECT table_name, count(*) FILTER (WHERE description IS NULL) AS n_missing, string_agg('| ' || column_name || ' | ' || type || ' | ' ||
      CASE WHEN is_nullable = 'NO' THEN 'NOT NULL' ELSE 'NULL' END || ' | ' || coalesce(description, {_GAP}) || ' | — |', chr(10) ORDER BY ordinal) AS rows
    FROM cols GROUP BY 1) c USING (table_name)
  LEFT JOIN pks USING (table_name)
  LEFT JOIN (SELECT table_name, string_agg('- `' || column_name || '` → `' || ref_table || '.' || ref_column || '`', chr(10) ORDER BY column_name) AS links
    FROM fks GROUP BY 1) f USING (table_name)
)"""
_CATALOG = ' (SELECT table_name AS "table", column_name AS "column", type FROM cols JOIN tabs USING (table_name))'
ORACLES = {
    "meta_tables": _META + " SELECT table_name, description FROM tabs",
    "meta_columns": _META + " SELECT table_name, ordinal, column_name, data_type, is_nullable, description FROM cols",
    "meta_pk": _META + " SELECT table_name, primary_key FROM pks",
    "meta_fk": _META + " SELECT table_name, column_name, ref_table, ref_column FROM fks",
    "meta_fmt_type": _META + " SELECT table_name, column_name, type FROM typed",
    "meta_render_doc": _META + " SELECT table_name, text FROM docs",
    "meta_doc_gaps": _META + " SELECT table_name, n_gaps FROM docs WHERE n_gaps > 0",
    "doc_sink": _META + " SELECT table_name, text FROM docs",
    "doc_lookup": _META + " SELECT table_name, text FROM docs WHERE substr(table_name, 6)::BIGINT % 20 = 0",
    "catalog_columns": _META + " SELECT * FROM" + _CATALOG,
    "column_tables": _META + ' SELECT "column", "table", count(*) OVER (PARTITION BY "column") AS n_tables FROM' + _CATALOG,
}
