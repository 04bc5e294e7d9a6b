"""Scores of answers against expected tables, and their roll-ups.

Answers are (draft_id, sql, explanation, expected_tables, expected_columns).
Expected columns are only tested for existence, never for use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.fixed import (
    DECLINE_PHRASES,
    PROSE_NONE,
    SCHEMA_QUALIFIERS,
    SQL_WORDS,
    TRICK_DECLINED,
    TRICK_SILENT,
    TRICK_WITH_SQL,
)
from gleaner.functions.text import contains_any, is_blank, plain_quotes, quoted_list, unnest
from gleaner.operators.drafts import references
from gleaner.session import write_table


def declines(explanation: Column) -> Column:
    return contains_any(plain_quotes(explanation), DECLINE_PHRASES)


def _scored(score: float, reason: Column) -> Column:
    return F.struct(F.lit(score).alias("score"), reason.alias("reason"))


def is_trick() -> Column:
    return F.size("expected") == 0


def has_sql() -> Column:
    return ~is_blank(F.col("sql"))


def prepare(answers: DataFrame) -> DataFrame:
    """Answers with their references and the expected tables lower-cased, sorted, each once."""
    lowered = F.transform("expected_tables", lambda name: F.lower(name))
    none = F.array().cast("array<string>")
    return references(answers).withColumn("expected", F.coalesce(F.sort_array(F.array_distinct(lowered)), none))


def trick_score() -> Column:
    """No table fits the question: only declining, without SQL, is right."""
    return (
        F.when(has_sql(), _scored(0.0, F.lit(TRICK_WITH_SQL)))
        .when(declines(F.col("explanation")), _scored(1.0, F.lit(TRICK_DECLINED)))
        .otherwise(_scored(0.0, F.lit(TRICK_SILENT)))
    )


def prose_score() -> Column:
    """An answer without SQL gets credit for expected tables it names as whole words."""
    prose = plain_quotes(F.col("explanation"))

    def is_named(table: Column) -> Column:
        return F.rlike(prose, F.concat(F.lit(r"\b\Q"), table, F.lit(r"\E\b")))

    named = F.filter("expected", is_named)
    absent = F.filter("expected", lambda table: ~is_named(table))
    return (
        F.when(F.size(absent) == 0, _scored(1.0, F.concat(F.lit("Prose answer names all expected tables: "), F.array_join(named, ", "))))
        .when(
            F.size(named) > 0,
            _scored(0.5, F.concat(F.lit("Prose answer — found "), quoted_list(named), F.lit(", missing "), quoted_list(absent))),
        )
        .otherwise(_scored(0.0, F.lit(PROSE_NONE)))
    )


def coverage_score() -> Column:
    """Share of the expected tables the draft references: all, some or none."""
    found = F.array_intersect("expected", "tables")
    absent = F.array_except("expected", "tables")
    return (
        F.when(F.size(absent) == 0, _scored(1.0, F.concat(F.lit("All expected tables present: "), F.array_join(found, ", "))))
        .when(
            F.size(found) > 0,
            _scored(0.5, F.concat(F.lit("Partial match — found "), quoted_list(found), F.lit(", missing "), quoted_list(absent))),
        )
        .otherwise(_scored(0.0, F.concat(F.lit("Expected tables not referenced: "), F.array_join("expected", ", "))))
    )


def unknown_names(prepared: DataFrame, catalog: DataFrame) -> DataFrame:
    """(draft_id, bad_tables, bad_columns) for drafts with any: referenced tables the catalog
    does not have, and referenced or expected columns that exist on no table.

    Both kinds of names are looked up by one join; only failures are grouped.
    """
    none = F.array().cast("array<string>")
    expected = F.transform(F.coalesce("expected_columns", none), lambda name: F.lower(name))
    tables = F.filter("tables", lambda name: F.length(name) > 2)
    columns = F.filter(
        F.array_union("columns", expected), lambda name: ~name.isin(SQL_WORDS) & ~name.isin(SCHEMA_QUALIFIERS)
    )

    def tagged(names: Column, kind: str) -> Column:
        return F.transform(names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))

    names = unnest(prepared, F.concat(tagged(tables, "table"), tagged(columns, "column")), "ref", "draft_id")
    table_names = catalog.select(F.col("table").alias("name"))
    known = (
        table_names.withColumn("kind", F.lit("table"))
        .unionByName(catalog.select(F.col("column").alias("name")).union(table_names).withColumn("kind", F.lit("column")))
        .distinct()
    )
    bad = names.select("draft_id", "ref.kind", "ref.name").join(known, ["kind", "name"], "left_anti")
    return bad.groupBy("draft_id").agg(
        *(
            F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(f"bad_{kind}s")
            for kind in ("table", "column")
        )
    )


def score_answers(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds score and reason to the answers; the first rule that applies decides."""
    plain = F.when(is_trick(), trick_score()).when(~has_sql(), prose_score()).otherwise(coverage_score())
    prepared = prepare(answers).select(
        *answers.columns, "tables", "columns", (~is_trick() & has_sql()).alias("by_names"), plain.alias("plain")
    )
    # Read by both sides of the join: names are found once, and texts are not moved for the score.
    prepared = write_table(prepared, "prepared-answers")
    joined = prepared.join(unknown_names(prepared, catalog), "draft_id", "left")
    result = (
        F.when(
            F.col("by_names") & (F.size("bad_tables") > 0),
            _scored(0.0, F.concat(F.lit("Hallucinated table names: "), F.array_join("bad_tables", ", "))),
        )
        .when(
            F.col("by_names") & (F.size("bad_columns") > 0),
            _scored(
                0.0, F.concat(F.lit("Referenced column(s) exist in no schema table: "), F.array_join("bad_columns", ", "))
            ),
        )
        .otherwise(F.col("plain"))
    )
    return joined.withColumn("result", result).select(*answers.columns, "result.score", "result.reason")


def paired(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rag, no_rag, delta): each question's scores with and without retrieval."""
    both = scores.groupBy(*keys).pivot("mode", ["rag", "no_rag"]).agg(F.avg("score"))
    return both.withColumn("delta", F.col("rag") - F.col("no_rag"))


def trial_summary(scores: DataFrame) -> DataFrame:
    """Per model: mean, population deviation, least and greatest of the trial means."""
    trials = scores.groupBy("model", "trial").agg(F.avg("score").alias("trial_mean"))
    return trials.groupBy("model").agg(
        F.avg("trial_mean").alias("mean_score"),
        F.stddev_pop("trial_mean").alias("deviation"),
        F.min("trial_mean").alias("worst"),
        F.max("trial_mean").alias("best"),
    )


def standard_and_trick(scores: DataFrame) -> DataFrame:
    """Per model: mean over standard questions, correct declines out of trick answers."""
    return scores.groupBy("model").agg(
        F.avg(F.when(~F.col("is_trick"), F.col("score"))).alias("standard_mean"),
        F.count_if(F.col("is_trick") & (F.col("score") == 1.0)).alias("declines"),
        F.count_if("is_trick").alias("trick_answers"),
    )


def latency(answers: DataFrame) -> DataFrame:
    return answers.groupBy("model").agg(F.avg("latency_ms").alias("mean_ms"), F.count(F.lit(1)).alias("n_answers"))


def report_lines(rows: DataFrame, title: str) -> DataFrame:
    """(line_no, line) of the evaluation report in Markdown.

    `rows`: question_no, question, rag, no_rag, citations, reason. Lines keep their
    numbers, so no task has to hold the whole report.
    """
    means = rows.agg(F.avg("rag").alias("rag"), F.avg("no_rag").alias("no_rag"))
    head = F.array(
        F.lit(f"# {title}"),
        F.lit(""),
        F.lit("## Summary"),
        F.lit(""),
        F.lit("| | Mean Score |"),
        F.lit("|---|---|"),
        F.concat(F.lit("| RAG enabled | **"), F.format_string("%.2f", "rag"), F.lit("** |")),
        F.concat(F.lit("| No RAG (baseline) | "), F.format_string("%.2f", "no_rag"), F.lit(" |")),
        F.lit(""),
        F.lit("## Question-by-question results"),
        F.lit(""),
        F.lit("| # | Question | RAG | No-RAG | Δ | Citations | Reason |"),
        F.lit("|---|---|---|---|---|---|---|"),
    )
    top = means.select(F.posexplode(head).alias("at", "line")).select((F.col("at") - 13).cast("long").alias("line_no"), "line")
    delta = F.col("rag") - F.col("no_rag")
    short = F.concat(F.substring("question", 1, 55), F.when(F.length("question") > 55, "…").otherwise(""))
    cited = F.when(F.coalesce("citations", F.lit("")) == "", "—").otherwise(F.col("citations"))
    cells = F.concat_ws(
        " | ",
        F.col("question_no").cast("string"),
        short,
        F.format_string("%.1f", "rag"),
        F.format_string("%.1f", "no_rag"),
        F.concat(F.when(delta > 0, "+").otherwise(""), F.format_string("%.1f", delta)),
        cited,
        F.col("reason"),
    )
    body = rows.select(F.col("question_no").cast("long").alias("line_no"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return top.unionByName(body)
