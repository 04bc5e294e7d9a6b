"""References and checks of SQL drafts: a table of (draft_id, sql) in, findings out.

A draft's names are found by patterns and kept as arrays on the draft's own
row, so finding them shuffles nothing. Only names that must be looked up in the
catalog are exploded and joined; what comes back are the few that failed.

Known limits: a CTE name after the first must have white space before it, of a
comma join only the first table is seen, and comments are read as SQL except
by the dialect check. Unqualified columns are not bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import (
    BACKTICK_FOUND,
    DOUBLE_COLON_FOUND,
    EMPTY_DRAFT,
    LIMIT_FOUND,
    SCHEMA_QUALIFIERS,
    SQL_WORDS,
)
from gleaner.functions.text import is_blank, quoted_list, unnest
from gleaner.session import write_table

CTE_NAME = r"(?:with|,)\s+(\w+)\s+as\s*\("
DERIVED_ALIAS = r"\)\s+(?:as\s+)?(\w+)"
TABLE_AND_ALIAS = r"(?:from|join)\s+(?:\w+\.)?(\w+)(?:\s+(?:as\s+)?(\w+))?"
QUALIFIED_TABLE = r"(?:from|join)\s+(\w+\.\w+)"
DOTTED = r"(\w+)\.(\w+)"
NOT_CODE = r"'[^']*'|\[[^\]]*\]|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/"

Domains = dict[str, list[str]]


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _is_word(name: Column) -> Column:
    return name.isin(SQL_WORDS)


def normalized(sql: Column) -> Column:
    """Lower case, string literals blanked, brackets dropped."""
    without_literals = F.regexp_replace(F.lower(F.coalesce(sql, F.lit(""))), "'[^']*'", " ")
    return F.translate(without_literals, "[]", "")


def references(drafts: DataFrame) -> DataFrame:
    """Adds the draft's names as arrays:

    cte_names, derived_aliases; from_refs (name, alias) in text order; from_tables;
    aliases of every kind; dotted (left, right); tables and columns, each once.
    """
    found = drafts.withColumn("clean", normalized(F.col("sql")))
    found = found.select(
        "*",
        _all(F.col("clean"), CTE_NAME, 1).alias("cte_names"),
        F.filter(_all(F.col("clean"), DERIVED_ALIAS, 1), lambda name: ~_is_word(name)).alias("derived_aliases"),
        F.arrays_zip(
            _all(F.col("clean"), TABLE_AND_ALIAS, 1).alias("name"),
            F.transform(
                _all(F.col("clean"), TABLE_AND_ALIAS, 2), lambda alias: F.when(~_is_word(alias), alias).otherwise("")
            ).alias("alias"),
        ).alias("from_refs"),
        _all(F.col("clean"), QUALIFIED_TABLE, 1).alias("qualified_tables"),
        F.transform(
            _all(F.col("clean"), DOTTED, 0),
            lambda name: F.struct(F.substring_index(name, ".", 1).alias("left"), F.substring_index(name, ".", -1).alias("right")),
        ).alias("dotted"),
    )
    local = F.concat("cte_names", "derived_aliases")
    from_aliases = F.transform("from_refs", lambda ref: ref["alias"])

    def names_a_table(ref: Column, at: Column) -> Column:
        name = ref["name"]
        return (
            ~_is_word(name)
            & ~name.isin(SCHEMA_QUALIFIERS)
            & (F.length(name) > 2)
            & ~F.array_contains(F.col("local_names"), name)
            # Only aliases declared before this reference hide a table of that name.
            & ~F.array_contains(F.slice(F.col("from_aliases"), F.lit(1), at), name)
        )

    found = found.withColumn("local_names", local).withColumn("from_aliases", from_aliases)
    found = found.withColumn(
        "from_tables", F.array_distinct(F.transform(F.filter("from_refs", names_a_table), lambda ref: ref["name"]))
    ).withColumn(
        "aliases",
        F.array_distinct(F.concat("local_names", F.filter("from_aliases", lambda alias: alias != ""))),
    )

    def names_a_left_table(ref: Column) -> Column:
        left = ref["left"]
        return (
            ~_is_word(left)
            & ~left.isin(SCHEMA_QUALIFIERS)
            & (F.length(left) > 1)
            & ~F.array_contains(F.col("aliases"), left)
        )

    def names_a_column(ref: Column) -> Column:
        return ~_is_word(ref["right"]) & (F.length(ref["right"]) > 2)

    left_tables = F.transform(F.filter("dotted", names_a_left_table), lambda ref: ref["left"])
    columns = F.transform(F.filter("dotted", names_a_column), lambda ref: ref["right"])
    return found.select(
        "*",
        F.array_distinct(F.concat("from_tables", left_tables)).alias("tables"),
        F.array_distinct(columns).alias("columns"),
    )


def dialect_error(sql: Column) -> Column:
    """Message for a backtick, LIMIT or '::' outside literals, quoted names and comments; else NULL."""

    def message(found: Column) -> Column:
        return (
            F.when(F.contains(found["code"], F.lit("`")), F.lit(BACKTICK_FOUND))
            .when(found["first"] == "::", F.lit(DOUBLE_COLON_FOUND))
            .when(found["first"] != "", F.lit(LIMIT_FOUND))
        )

    # Arrays of one: the code and what is found in it are worked out once, not once per branch.
    code = F.array(F.regexp_replace(sql, NOT_CODE, " "))
    found = F.transform(code, lambda c: F.struct(c.alias("code"), F.regexp_extract(c, r"(?i)\blimit\b|::", 0).alias("first")))
    return F.get(F.transform(found, message), F.lit(0))


def bound_columns(refs: DataFrame) -> DataFrame:
    """(draft_id, qualifier, column, table, is_local): what each `qualifier.column` stands
    for. `table` is NULL for a qualifier the draft never declares; `is_local` marks
    CTEs and derived tables, whose columns no catalog knows."""

    def is_column_ref(ref: Column) -> Column:
        return ~ref["left"].isin(SCHEMA_QUALIFIERS) & ~F.array_contains(
            F.col("qualified_tables"), F.concat(ref["left"], F.lit("."), ref["right"])
        )

    column_refs = F.array_distinct(F.filter("dotted", is_column_ref))
    exploded = unnest(refs, column_refs, "ref", "draft_id", "from_refs", "local_names")
    declared = F.filter(
        "from_refs",
        lambda table: F.when(table["alias"] != "", table["alias"]).otherwise(table["name"]) == F.col("ref.left"),
    )
    table = F.try_element_at(F.transform(declared, lambda t: t["name"]), F.lit(1))
    return exploded.select(
        "draft_id",
        F.col("ref.left").alias("qualifier"),
        F.col("ref.right").alias("column"),
        table.alias("table"),
        (
            F.array_contains("local_names", F.col("ref.left"))
            | F.coalesce(F.array_contains("local_names", table), F.lit(False))
        ).alias("is_local"),
    )


def column_findings(bound: DataFrame, catalog: DataFrame) -> DataFrame:
    """(draft_id, qualifier, column, error, warning) for references that do not hold.

    Errors: a column its table does not have; a qualifier that stands for nothing.
    Warnings: references into CTEs and derived tables, neither confirmed nor
    refuted. Tables outside the catalog bind nothing.
    """
    tables = catalog.select("table").distinct().withColumn("is_known", F.lit(True))
    columns = catalog.select("table", "column").distinct().withColumn("exists", F.lit(True))
    joined = bound.join(tables, "table", "left").join(columns, ["table", "column"], "left")
    full_name = F.concat(F.col("qualifier"), F.lit("."), F.col("column"))
    lost = F.concat(F.lit("Column binding failed: Column '"), full_name, F.lit("' could not be resolved"))
    missing = F.concat(F.lit("Column binding failed: Unknown column: "), F.col("column"))
    unsure = F.concat(F.lit("Could not fully validate columns (warning): "), full_name)
    error = F.when(F.col("table").isNull(), lost).when(F.col("is_known") & F.col("exists").isNull(), missing)
    found = joined.select(
        "draft_id",
        "qualifier",
        "column",
        F.when(~F.col("is_local"), error).alias("error"),
        F.when(F.col("is_local"), unsure).alias("warning"),
    )
    return found.where(F.col("error").isNotNull() | F.col("warning").isNotNull())


def code_literals(sql: Column, column: str = "status_cd") -> Column:
    """String literals compared to the code column, each once, in text order."""
    name = rf"\b{column}\b\]?"
    one = rf"{name}\s*(?:=|<>|!=)\s*'([^']*)'"
    turned = rf"'([^']*)'\s*(?:=|<>|!=)\s*(?:\[?\w+\]?\.)?\[?{column}\b"
    several = rf"{name}\s+(?:not\s+)?in\s*\(([^)]*)\)"
    pattern = f"(?i){one}|{turned}|{several}"
    found = F.arrays_zip(*(_all(sql, pattern, group).alias(f"g{group}") for group in (1, 2, 3)))

    def values(match: Column) -> Column:
        return (
            F.when(match["g3"] != "", _all(match["g3"], "'([^']*)'", 1))
            .when(match["g2"] != "", F.array(match["g2"]))
            .otherwise(F.array(match["g1"]))
        )

    # Most drafts do not name the column.
    return F.when(~F.contains(F.lower(sql), F.lit(column.lower())), F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(found, values)))
    )


def governed_tables(from_tables: Column, table_entity: dict[str, str]) -> Column:
    """Tables whose code column has a known domain."""
    return F.sort_array(F.array_intersect(from_tables, F.array(*map(F.lit, sorted(table_entity)))))


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def domain_errors(literals: Column, governed: Column, domains: Domains, table_entity: dict[str, str]) -> Column:
    """Array of messages. A code of no entity is an error; a code of another entity only
    where exactly one governed table makes the entity certain."""
    everywhere = _array(sorted({value for values in domains.values() for value in values}))
    entity_of = F.create_map(*(F.lit(x) for pair in sorted(table_entity.items()) for x in pair))
    values_of = F.create_map(*(x for name in sorted(domains) for x in (F.lit(name), _array(sorted(domains[name])))))
    entity = F.when(F.size(governed) == 1, entity_of[F.get(governed, F.lit(0))])
    names = "/".join(sorted(name.lower() for name in domains))

    def message(literal: Column) -> Column:
        shown = F.concat(F.lit("Invalid status_cd value '"), literal, F.lit("'"))
        nowhere = F.concat(shown, F.lit(f": not a valid status code in any entity domain ({names})."))
        elsewhere = F.concat(
            shown, F.lit(" for "), F.lower(entity), F.lit(" query: valid status codes for "), entity, F.lit(" are "),
            quoted_list(values_of[entity]), F.lit("."),
        )
        upper = F.upper(literal)
        return F.when(~F.array_contains(everywhere, upper), nowhere).when(
            ~F.array_contains(values_of[entity], upper), elsewhere
        )

    return F.filter(F.transform(literals, message), lambda m: m.isNotNull())


def validate(drafts: DataFrame, catalog: DataFrame, domains: Domains, table_entity: dict[str, str]) -> DataFrame:
    """(draft_id, ok, errors, warnings) for every draft.

    A blank draft and a dialect error end the checks; otherwise binding errors
    come first, then code errors.
    """
    # Read by both sides of the join below: names are found once.
    checked = references(drafts).select(
        "draft_id",
        "from_refs",
        "local_names",
        "qualified_tables",
        "dotted",
        F.when(is_blank(F.col("sql")), F.lit(EMPTY_DRAFT)).otherwise(dialect_error(F.col("sql"))).alias("stop"),
        domain_errors(
            code_literals(F.col("sql")), governed_tables(F.col("from_tables"), table_entity), domains, table_entity
        ).alias("code_errors"),
    )
    checked = write_table(checked, "checked-drafts")
    # A draft's findings are bounded by its own text.
    findings = (
        column_findings(bound_columns(checked), catalog)
        .groupBy("draft_id")
        .agg(
            F.sort_array(F.collect_set("error")).alias("bind_errors"),
            F.sort_array(F.collect_set("warning")).alias("bind_warnings"),
        )
    )
    none = F.array().cast("array<string>")
    verdict = checked.select("draft_id", "stop", "code_errors").join(findings, "draft_id", "left").select(
        "draft_id",
        F.when(F.col("stop").isNotNull(), F.array("stop"))
        .otherwise(F.concat(F.coalesce("bind_errors", none), "code_errors"))
        .alias("errors"),
        F.when(F.col("stop").isNotNull(), none).otherwise(F.coalesce("bind_warnings", none)).alias("warnings"),
    )
    return verdict.select("draft_id", (F.size("errors") == 0).alias("ok"), "errors", "warnings")


def gate(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds ok, errors, warnings to (draft_id, sql, ...). An answer without SQL passes; one
    whose check is missing passes with a warning."""
    none = F.array().cast("array<string>")
    no_sql = is_blank(F.col("sql"))
    missing = F.when(~no_sql, F.array(F.lit("validator did not run"))).otherwise(none)
    checked = answers.join(verdicts, "draft_id", "left")
    unchecked = no_sql | F.col("ok").isNull()
    return checked.select(
        *answers.columns,
        F.when(unchecked, True).otherwise(F.col("ok")).alias("ok"),
        F.when(unchecked, none).otherwise(F.col("errors")).alias("errors"),
        F.when(unchecked, missing).otherwise(F.col("warnings")).alias("warnings"),
    )
