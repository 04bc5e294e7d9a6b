"""Registered draft-analysis and scoring queries over one answer per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.text import first_fenced_block, unnest
from gleaner.operators import assembly, drafts, scoring
from gleaner.plans.fixtures import (
    DOMAINS,
    TABLE_ENTITY,
    answers,
    answers_sql,
    catalog_rows,
    catalog_sql,
    text_literal,
)
from gleaner.session import write_table
from gleaner.sources.tables import Tables, spread


def _answers(spark, folder):
    rows = answers(spread(Tables(spark, folder).orders.select("o_orderkey"), "o_orderkey"))
    return rows.withColumn("sql", first_fenced_block(F.col("explanation")))


def _refs(spark, folder):
    return drafts.references(_answers(spark, folder).select("draft_id", "sql"))


def _joined(name):
    return F.array_join(name, ", ")


def extract_sql(spark, folder):
    return _answers(spark, folder).select("draft_id", "sql")


def draft_normalize(spark, folder):
    return _refs(spark, folder).select("draft_id", "clean")


def draft_cte_names(spark, folder):
    return unnest(_refs(spark, folder), "cte_names", "name", "draft_id")


def draft_derived_aliases(spark, folder):
    return unnest(_refs(spark, folder), "derived_aliases", "name", "draft_id")


def draft_table_refs(spark, folder):
    return unnest(_refs(spark, folder), "from_tables", "table", "draft_id")


def draft_column_refs(spark, folder):
    return unnest(_refs(spark, folder), "columns", "column", "draft_id")


def draft_identifiers(spark, folder):
    return _refs(spark, folder).select(
        "draft_id", _joined(F.sort_array("tables")).alias("tables"), _joined(F.sort_array("columns")).alias("columns")
    )


def draft_dialect(spark, folder):
    rows = _answers(spark, folder)
    return rows.select("draft_id", drafts.dialect_error(F.col("sql")).alias("error")).where(F.col("error").isNotNull())


def _findings(spark, folder, kind):
    found = drafts.column_findings(drafts.bound_columns(_refs(spark, folder)), catalog_rows(spark))
    return found.where(F.col(kind).isNotNull()).select("draft_id", "qualifier", "column", kind)


def draft_binding(spark, folder):
    return _findings(spark, folder, "error")


def draft_binding_warnings(spark, folder):
    return _findings(spark, folder, "warning")


def draft_code_literals(spark, folder):
    found = drafts.code_literals(F.col("sql"))
    return _answers(spark, folder).select("draft_id", F.posexplode(found).alias("at", "literal")).select(
        "draft_id", (F.col("at") + 1).cast("long").alias("position"), "literal"
    )


def draft_governed_tables(spark, folder):
    found = drafts.governed_tables(F.col("from_tables"), TABLE_ENTITY)
    return unnest(_refs(spark, folder), found, "table", "draft_id")


def draft_domain_check(spark, folder):
    refs = _refs(spark, folder)
    governed = drafts.governed_tables(F.col("from_tables"), TABLE_ENTITY)
    errors = drafts.domain_errors(drafts.code_literals(F.col("sql")), governed, DOMAINS, TABLE_ENTITY)
    return unnest(refs, errors, "error", "draft_id")


def _verdicts(spark, folder):
    rows = _answers(spark, folder).select("draft_id", "sql")
    return drafts.validate(rows, catalog_rows(spark), DOMAINS, TABLE_ENTITY)


def validate_drafts(spark, folder):
    return _verdicts(spark, folder).select(
        "draft_id", "ok", F.array_join("errors", "\n").alias("errors"), F.array_join("warnings", "\n").alias("warnings")
    )


def _gated(spark, folder):
    return drafts.gate(_answers(spark, folder), _verdicts(spark, folder))


def validation_gate(spark, folder):
    return _gated(spark, folder).select("draft_id", "ok", F.array_join("errors", "\n").alias("errors"))


def format_reply(spark, folder):
    return assembly.replies(_gated(spark, folder)).select("draft_id", "reply")


def decline_detect(spark, folder):
    return _answers(spark, folder).select("draft_id", scoring.declines(F.col("explanation")).alias("declines"))


def _prepared(spark, folder):
    return scoring.prepare(_answers(spark, folder))


def _result(rows, result):
    return rows.withColumn("result", result).select("draft_id", "result.score", "result.reason")


def score_trick(spark, folder):
    return _result(_prepared(spark, folder).where(scoring.is_trick()), scoring.trick_score())


def score_prose(spark, folder):
    rows = _prepared(spark, folder).where(~scoring.is_trick() & ~scoring.has_sql())
    return _result(rows, scoring.prose_score())


def _with_sql(spark, folder):
    return _prepared(spark, folder).where(~scoring.is_trick() & scoring.has_sql())


def _unknown(spark, folder, names):
    found = scoring.unknown_names(_with_sql(spark, folder), catalog_rows(spark))
    return found.where(F.size(names) > 0).select("draft_id", _joined(names).alias("names"))


def score_unknown_tables(spark, folder):
    return _unknown(spark, folder, "bad_tables")


def score_unknown_columns(spark, folder):
    return _unknown(spark, folder, "bad_columns")


def score_coverage(spark, folder):
    return _result(_with_sql(spark, folder), scoring.coverage_score())


def score_answers(spark, folder):
    return _scores(spark, folder).select("draft_id", "score", "reason")


def _scores(spark, folder):
    scored = scoring.score_answers(_answers(spark, folder), catalog_rows(spark))
    return scored.withColumn("is_trick", F.size("expected_tables") == 0)


def eval_paired(spark, folder):
    return scoring.paired(_scores(spark, folder), ["question_no", "model", "trial"])


def eval_means(spark, folder):
    return _scores(spark, folder).groupBy("mode").agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n_answers")
    )


def eval_trials(spark, folder):
    rows = scoring.trial_summary(_scores(spark, folder).where(F.col("mode") == "rag"))
    return rows.select("model", *(F.round(c, 6).alias(c) for c in ("mean_score", "deviation", "worst", "best")))


def eval_real_vs_trick(spark, folder):
    rows = scoring.standard_and_trick(_scores(spark, folder).where(F.col("mode") == "rag"))
    return rows.withColumn("standard_mean", F.round("standard_mean", 6))


def eval_latency(spark, folder):
    return scoring.latency(_answers(spark, folder)).withColumn("mean_ms", F.round("mean_ms", 6))


def report_rows(spark, folder):
    """One report row per question: mean scores of both modes, cited tables, and the
    reason of its first answer with retrieval."""
    scored = _scores(spark, folder)
    rag = F.col("mode") == "rag"
    first = F.min_by(F.struct("reason", "expected_tables"), F.when(rag, F.col("draft_id")))
    rows = scored.groupBy("question_no").agg(
        F.avg(F.when(rag, F.col("score"))).alias("rag"), F.avg(F.when(~rag, F.col("score"))).alias("no_rag"), first.alias("first")
    )
    question = F.concat(
        F.lit("Which tables and columns answer the request with number "), F.col("question_no").cast("string"), F.lit("?")
    )
    cited = F.array_join(F.transform("first.expected_tables", lambda t: F.concat(t, F.lit(".md"))), ", ")
    # A question may still lack answers in one mode at the edge of the data.
    return rows.where(F.col("rag").isNotNull() & F.col("no_rag").isNotNull()).select(
        "question_no", question.alias("question"), "rag", "no_rag", cited.alias("citations"), "first.reason"
    )


def eval_report(spark, folder):
    # Read twice, for the means and for the lines.
    rows = write_table(report_rows(spark, folder), "report-rows")
    return scoring.report_lines(rows, "Draft evaluation report")


QUERIES = {
    f.__name__: f
    for f in (
        extract_sql, draft_normalize, draft_cte_names, draft_derived_aliases, draft_table_refs, draft_column_refs,
        draft_identifiers, draft_dialect, draft_binding, draft_binding_warnings, draft_code_literals,
        draft_governed_tables, draft_domain_check, validate_drafts, validation_gate, format_reply, decline_detect,
        score_trick, score_prose, score_unknown_tables, score_unknown_columns, score_coverage, score_answers,
        eval_paired, eval_means, eval_trials, eval_real_vs_trick, eval_latency, eval_report,
    )
}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(text_literal(w) for w in words) + ")"


_WORDS, _QUALIFIERS = _in(fixed.SQL_WORDS), _in(fixed.SCHEMA_QUALIFIERS)
_BASE = rf"""WITH answers AS ({answers_sql()}), catalog AS (SELECT * FROM {catalog_sql()}),
sqls AS (
  SELECT *, coalesce(regexp_replace(regexp_extract(explanation, '(?is)```(?:sql)?\s*\n?(.*?)```', 1), '^\s+|\s+$', '', 'g'), '') AS sql
  FROM answers
), cleaned AS (
  SELECT draft_id, replace(replace(regexp_replace(lower(sql), '''[^'']*''', ' ', 'g'), '[', ''), ']', '') AS clean FROM sqls
), ctes AS (
  SELECT draft_id, unnest(regexp_extract_all(clean, '(?:with|,)\s+(\w+)\s+as\s*\(', 1)) AS name FROM cleaned
), derived AS (
  SELECT * FROM (SELECT draft_id, unnest(regexp_extract_all(clean, '\)\s+(?:as\s+)?(\w+)', 1)) AS name FROM cleaned)
  WHERE name NOT IN {_WORDS}
), locals AS (SELECT draft_id, name FROM ctes UNION SELECT draft_id, name FROM derived),
from_matches AS (
  SELECT draft_id,
    regexp_extract_all(clean, '(?:from|join)\s+(?:\w+\.)?(\w+)(?:\s+(?:as\s+)?(\w+))?', 1) AS names,
    regexp_extract_all(clean, '(?:from|join)\s+(?:\w+\.)?(\w+)(?:\s+(?:as\s+)?(\w+))?', 2) AS aliases FROM cleaned
), from_refs AS (
  SELECT draft_id, pos, name, CASE WHEN alias IN {_WORDS} THEN '' ELSE coalesce(alias, '') END AS alias
  FROM (SELECT draft_id, unnest(range(1, len(names) + 1)) AS pos, unnest(names) AS name, unnest(aliases) AS alias FROM from_matches)
), from_tables AS (
  SELECT DISTINCT draft_id, name FROM from_refs f
  WHERE name NOT IN {_WORDS} AND name NOT IN {_QUALIFIERS} AND length(name) > 2
    AND NOT EXISTS (SELECT 1 FROM locals l WHERE l.draft_id = f.draft_id AND l.name = f.name)
    AND NOT EXISTS (SELECT 1 FROM from_refs e WHERE e.draft_id = f.draft_id AND e.alias = f.name AND e.pos < f.pos)
), aliases AS (SELECT draft_id, name FROM locals UNION SELECT draft_id, alias FROM from_refs WHERE alias <> ''),
dotted AS (
  SELECT draft_id, unnest(regexp_extract_all(clean, '(\w+)\.(\w+)', 1)) AS l, unnest(regexp_extract_all(clean, '(\w+)\.(\w+)', 2)) AS r
  FROM cleaned
), left_tables AS (
  SELECT DISTINCT draft_id, l AS name FROM dotted d
  WHERE l NOT IN {_WORDS} AND l NOT IN {_QUALIFIERS} AND length(l) > 1
    AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.draft_id = d.draft_id AND a.name = d.l)
), tabs AS (SELECT draft_id, name FROM from_tables UNION SELECT draft_id, name FROM left_tables),
cols AS (SELECT DISTINCT draft_id, r AS name FROM dotted WHERE r NOT IN {_WORDS} AND length(r) > 2),
dialect AS (
  SELECT draft_id, CASE WHEN contains(code, '`') THEN {text_literal(fixed.BACKTICK_FOUND)}
    WHEN first = '::' THEN {text_literal(fixed.DOUBLE_COLON_FOUND)} WHEN first <> '' THEN {text_literal(fixed.LIMIT_FOUND)} END AS error
  FROM (SELECT draft_id, code, regexp_extract(code, '(?i)\blimit\b|::', 0) AS first FROM (
    SELECT draft_id, regexp_replace(regexp_replace(sql, '''[^'']*''', ' ', 'g'), '\[[^\]]*\]', ' ', 'g') AS code FROM sqls))
), bound AS (
  SELECT DISTINCT d.draft_id, d.l AS qualifier, d.r AS "column", f.name AS "table",
    EXISTS (SELECT 1 FROM locals x WHERE x.draft_id = d.draft_id AND (x.name = d.l OR x.name = f.name)) AS is_local
  FROM dotted d JOIN cleaned USING (draft_id)
  LEFT JOIN from_refs f ON f.draft_id = d.draft_id AND d.l = CASE WHEN f.alias <> '' THEN f.alias ELSE f.name END
  WHERE d.l NOT IN {_QUALIFIERS} AND NOT regexp_matches(clean, '(?:from|join)\s+' || d.l || '\.' || d.r || '(\W|$)')
), bind_errors AS (
  SELECT draft_id, qualifier, "column", CASE WHEN "table" IS NULL
      THEN 'Column binding failed: Column ''' || qualifier || '.' || "column" || ''' could not be resolved'
      ELSE 'Column binding failed: Unknown column: ' || "column" END AS error
  FROM bound b WHERE NOT is_local AND ("table" IS NULL OR (
    "table" IN (SELECT "table" FROM catalog)
    AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c."table" = b."table" AND c."column" = b."column")))
), bind_warnings AS (
  SELECT draft_id, qualifier, "column", 'Could not fully validate columns (warning): ' || qualifier || '.' || "column" AS warning
  FROM bound WHERE is_local
), literal_matches AS (
  SELECT draft_id, list_concat(list_concat(
    regexp_extract_all(sql, '(?i)\bstatus_cd\s*(?:=|<>|!=)\s*''([^'']*)''', 1),
    regexp_extract_all(sql, '(?i)''([^'']*)''\s*(?:=|<>|!=)\s*(?:\w+\.)?status_cd\b', 1)),
    regexp_extract_all(array_to_string(regexp_extract_all(sql, '(?i)\bstatus_cd\s+(?:not\s+)?in\s*\(([^)]*)\)', 1), ','), '''([^'']*)''', 1)) AS found
  FROM sqls
), literals AS (
  SELECT draft_id, unnest(range(1, len(found) + 1)) AS position, unnest(found) AS literal FROM literal_matches
), governed AS (SELECT draft_id, name FROM from_tables WHERE name IN {_in(list(TABLE_ENTITY))}),
entity AS (
  SELECT draft_id, any_value(CASE name {' '.join(f"WHEN '{t}' THEN '{e}'" for t, e in TABLE_ENTITY.items())} END) AS entity
  FROM governed GROUP BY draft_id HAVING count(*) = 1
), code_domains AS (SELECT * FROM (VALUES {', '.join(f"('{e}', '{v}')" for e, vs in DOMAINS.items() for v in vs)}) AS t(entity, value)),
code_errors AS (
  SELECT draft_id, position, CASE WHEN upper(literal) NOT IN (SELECT value FROM code_domains)
      THEN 'Invalid status_cd value ''' || literal || ''': not a valid status code in any entity domain (customer/line/order).'
      ELSE 'Invalid status_cd value ''' || literal || ''' for ' || lower(entity) || ' query: valid status codes for ' || entity || ' are ['''
        || (SELECT string_agg(value, ''', ''' ORDER BY value) FROM code_domains d WHERE d.entity = e.entity) || '''].' END AS error
  FROM literals LEFT JOIN entity e USING (draft_id)
  WHERE upper(literal) NOT IN (SELECT value FROM code_domains)
    OR (entity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM code_domains d WHERE d.entity = e.entity AND d.value = upper(literal)))
), verdicts AS (
  SELECT s.draft_id, sql, CASE WHEN sql = '' THEN '{fixed.EMPTY_DRAFT}' WHEN error IS NOT NULL THEN error
      ELSE concat_ws(chr(10), b, c) END AS errors,
    CASE WHEN sql = '' OR error IS NOT NULL THEN '' ELSE coalesce(w, '') END AS warnings
  FROM sqls s JOIN dialect USING (draft_id)
  LEFT JOIN (SELECT draft_id, string_agg(error, chr(10) ORDER BY error) AS b FROM (SELECT DISTINCT draft_id, error FROM bind_errors) GROUP BY 1) USING (draft_id)
  LEFT JOIN (SELECT draft_id, string_agg(error, chr(10) ORDER BY position) AS c FROM code_errors GROUP BY 1) USING (draft_id)
  LEFT JOIN (SELECT draft_id, string_agg(warning, chr(10) ORDER BY warning) AS w FROM (SELECT DISTINCT draft_id, warning FROM bind_warnings) GROUP BY 1) USING (draft_id)
), gated AS (
  SELECT draft_id, sql = '' OR errors = '' AS ok, CASE WHEN sql = '' THEN '' ELSE errors END AS errors FROM verdicts
)"""
_SCORES = rf""", prose AS (
  SELECT draft_id, replace(replace(lower(explanation), '’', ''''), '‘', '''') AS said FROM answers
), declined AS (
  SELECT draft_id, {' OR '.join(f"contains(said, {text_literal(p)})" for p in fixed.DECLINE_PHRASES)} AS declines FROM prose
), expected AS (SELECT draft_id, unnest(expected_tables) AS name FROM answers),
named AS (
  SELECT draft_id, count(*) AS n, count(*) FILTER (WHERE is_named) AS n_named,
    string_agg(name, ', ' ORDER BY name) FILTER (WHERE is_named) AS named,
    '[''' || string_agg(name, ''', ''' ORDER BY name) FILTER (WHERE is_named) || ''']' AS named_list,
    '[''' || string_agg(name, ''', ''' ORDER BY name) FILTER (WHERE NOT is_named) || ''']' AS absent_list
  FROM (SELECT draft_id, name, regexp_matches(said, '\b' || name || '\b') AS is_named FROM expected JOIN prose USING (draft_id)) GROUP BY 1
), covered AS (
  SELECT draft_id, count(*) AS n, count(*) FILTER (WHERE is_used) AS n_used,
    string_agg(name, ', ' ORDER BY name) AS every,
    '[''' || string_agg(name, ''', ''' ORDER BY name) FILTER (WHERE is_used) || ''']' AS used_list,
    '[''' || string_agg(name, ''', ''' ORDER BY name) FILTER (WHERE NOT is_used) || ''']' AS absent_list
  FROM (SELECT draft_id, name, (draft_id, name) IN (SELECT draft_id, name FROM tabs) AS is_used FROM expected) GROUP BY 1
), bad_tables AS (
  SELECT draft_id, string_agg(name, ', ' ORDER BY name) AS names FROM tabs
  WHERE length(name) > 2 AND name NOT IN (SELECT "table" FROM catalog) GROUP BY 1
), bad_columns AS (
  SELECT draft_id, string_agg(name, ', ' ORDER BY name) AS names FROM (
    SELECT draft_id, name FROM cols UNION SELECT draft_id, lower(unnest(expected_columns)) FROM answers
  ) WHERE name NOT IN {_WORDS} AND name NOT IN {_QUALIFIERS}
    AND name NOT IN (SELECT "column" FROM catalog) AND name NOT IN (SELECT "table" FROM catalog) GROUP BY 1
), trick AS (
  SELECT draft_id, CASE WHEN sql = '' AND declines THEN 1.0::DOUBLE ELSE 0.0 END AS score,
    CASE WHEN sql <> '' THEN {text_literal(fixed.TRICK_WITH_SQL)} WHEN declines THEN {text_literal(fixed.TRICK_DECLINED)}
      ELSE {text_literal(fixed.TRICK_SILENT)} END AS reason
  FROM sqls JOIN declined USING (draft_id) WHERE len(expected_tables) = 0
), prose_scores AS (
  SELECT draft_id, CASE WHEN n_named = n THEN 1.0::DOUBLE WHEN n_named > 0 THEN 0.5 ELSE 0.0 END AS score,
    CASE WHEN n_named = n THEN 'Prose answer names all expected tables: ' || named
      WHEN n_named > 0 THEN 'Prose answer — found ' || named_list || ', missing ' || absent_list
      ELSE {text_literal(fixed.PROSE_NONE)} END AS reason
  FROM sqls JOIN named USING (draft_id) WHERE sql = ''
), coverage AS (
  SELECT draft_id, CASE WHEN n_used = n THEN 1.0::DOUBLE WHEN n_used > 0 THEN 0.5 ELSE 0.0 END AS score,
    CASE WHEN n_used = n THEN 'All expected tables present: ' || every
      WHEN n_used > 0 THEN 'Partial match — found ' || used_list || ', missing ' || absent_list
      ELSE 'Expected tables not referenced: ' || every END AS reason
  FROM sqls JOIN covered USING (draft_id) WHERE sql <> ''
), scores AS (
  SELECT * FROM trick UNION ALL SELECT * FROM prose_scores UNION ALL
  SELECT draft_id, CASE WHEN t.names IS NOT NULL OR c.names IS NOT NULL THEN 0.0 ELSE score END,
    CASE WHEN t.names IS NOT NULL THEN 'Hallucinated table names: ' || t.names
      WHEN c.names IS NOT NULL THEN 'Referenced column(s) exist in no schema table: ' || c.names ELSE reason END
  FROM coverage LEFT JOIN bad_tables t USING (draft_id) LEFT JOIN bad_columns c USING (draft_id)
), scored AS (SELECT * FROM scores JOIN answers USING (draft_id))"""
_WITH_SQL = " JOIN sqls USING (draft_id) WHERE sql <> '' AND len(expected_tables) > 0"

ORACLES = {
    "extract_sql": _BASE + " SELECT draft_id, sql FROM sqls",
    "draft_normalize": _BASE + " SELECT draft_id, clean FROM cleaned",
    "draft_cte_names": _BASE + " SELECT draft_id, name FROM ctes",
    "draft_derived_aliases": _BASE + " SELECT draft_id, name FROM derived",
    "draft_table_refs": _BASE + ' SELECT draft_id, name AS "table" FROM from_tables',
    "draft_column_refs": _BASE + ' SELECT draft_id, name AS "column" FROM cols',
    "draft_identifiers": _BASE + """ SELECT draft_id, coalesce(t, '') AS tables, coalesce(c, '') AS columns FROM sqls
        LEFT JOIN (SELECT draft_id, string_agg(name, ', ' ORDER BY name) AS t FROM tabs GROUP BY 1) USING (draft_id)
        LEFT JOIN (SELECT draft_id, string_agg(name, ', ' ORDER BY name) AS c FROM cols GROUP BY 1) USING (draft_id)""",
    "draft_dialect": _BASE + " SELECT draft_id, error FROM dialect WHERE error IS NOT NULL",
    "draft_binding": _BASE + ' SELECT draft_id, qualifier, "column", error FROM bind_errors',
    "draft_binding_warnings": _BASE + ' SELECT draft_id, qualifier, "column", warning FROM bind_warnings',
    "draft_code_literals": _BASE + " SELECT draft_id, position, literal FROM literals",
    "draft_governed_tables": _BASE + ' SELECT draft_id, name AS "table" FROM governed',
    "draft_domain_check": _BASE + " SELECT draft_id, error FROM code_errors",
    "validate_drafts": _BASE + " SELECT draft_id, errors = '' AS ok, errors, warnings FROM verdicts",
    "validation_gate": _BASE + " SELECT draft_id, ok, errors FROM gated",
    "format_reply": _BASE + f""" SELECT draft_id, explanation || CASE WHEN ok THEN '' ELSE {text_literal(fixed.CHECK_FLAG)}
        || '> - ' || replace(errors, chr(10), chr(10) || '> - ') END AS reply FROM gated JOIN answers USING (draft_id)""",
    "decline_detect": _BASE + _SCORES + " SELECT draft_id, declines FROM declined",
    "score_trick": _BASE + _SCORES + " SELECT draft_id, score, reason FROM trick",
    "score_prose": _BASE + _SCORES + " SELECT draft_id, score, reason FROM prose_scores",
    "score_unknown_tables": _BASE + _SCORES + " SELECT draft_id, names FROM bad_tables" + _WITH_SQL,
    "score_unknown_columns": _BASE + _SCORES + " SELECT draft_id, names FROM bad_columns" + _WITH_SQL,
    "score_coverage": _BASE + _SCORES + " SELECT draft_id, score, reason FROM coverage",
    "score_answers": _BASE + _SCORES + " SELECT draft_id, score, reason FROM scores",
    "eval_paired": _BASE + _SCORES + """ SELECT question_no, model, trial, rag, no_rag, rag - no_rag AS delta FROM (
        SELECT question_no, model, trial, avg(score) FILTER (WHERE mode = 'rag') AS rag,
          avg(score) FILTER (WHERE mode = 'no_rag') AS no_rag FROM scored GROUP BY ALL)""",
    "eval_means": _BASE + _SCORES + " SELECT mode, round(avg(score), 6) AS mean_score, count(*) AS n_answers FROM scored GROUP BY 1",
    "eval_trials": _BASE + _SCORES + """ SELECT model, round(avg(m), 6) AS mean_score, round(stddev_pop(m), 6) AS deviation,
        round(min(m), 6) AS worst, round(max(m), 6) AS best
        FROM (SELECT model, trial, avg(score) AS m FROM scored WHERE mode = 'rag' GROUP BY ALL) GROUP BY 1""",
    "eval_real_vs_trick": _BASE + _SCORES + """ SELECT model,
        round(avg(score) FILTER (WHERE len(expected_tables) > 0), 6) AS standard_mean,
        count(*) FILTER (WHERE len(expected_tables) = 0 AND score = 1.0) AS declines,
        count(*) FILTER (WHERE len(expected_tables) = 0) AS trick_answers FROM scored WHERE mode = 'rag' GROUP BY 1""",
    "eval_latency": _BASE + " SELECT model, round(avg(latency_ms), 6) AS mean_ms, count(*) AS n_answers FROM answers GROUP BY 1",
    "eval_report": _BASE + _SCORES + """, questions AS (
        SELECT question_no, avg(score) FILTER (WHERE mode = 'rag') AS rag, avg(score) FILTER (WHERE mode = 'no_rag') AS no_rag,
          arg_min(reason, draft_id) FILTER (WHERE mode = 'rag') AS reason,
          arg_min(expected_tables, draft_id) FILTER (WHERE mode = 'rag') AS cited,
          'Which tables and columns answer the request with number ' || question_no || '?' AS question
        FROM scored GROUP BY question_no HAVING rag IS NOT NULL AND no_rag IS NOT NULL
      ), means AS (SELECT avg(rag) AS rag, avg(no_rag) AS no_rag FROM questions),
      head AS (SELECT ['# Draft evaluation report', '', '## Summary', '', '| | Mean Score |', '|---|---|',
        printf('| RAG enabled | **%.2f** |', round(rag, 2)), printf('| No RAG (baseline) | %.2f |', round(no_rag, 2)), '',
        '## Question-by-question results', '', '| # | Question | RAG | No-RAG | Δ | Citations | Reason |',
        '|---|---|---|---|---|---|---|'] AS h FROM means)
      SELECT unnest(range(-13, 0)) AS line_no, unnest(h) AS line FROM head UNION ALL
      SELECT question_no, '| ' || question_no || ' | ' || question[:55] || CASE WHEN length(question) > 55 THEN '…' ELSE '' END
        || printf(' | %.1f | %.1f | ', round(rag, 1), round(no_rag, 1)) || CASE WHEN rag > no_rag THEN '+' ELSE '' END || printf('%.1f | ', round(rag - no_rag, 1))
        || coalesce(nullif(array_to_string(list_transform(cited, lambda t: t || '.md'), ', '), ''), '—') || ' | ' || reason || ' |'
      FROM questions""",
}
