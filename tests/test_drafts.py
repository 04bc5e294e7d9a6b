import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import first_fenced_block
from gleaner.operators import assembly, drafts, scoring

CATALOG = {
    "members": ["member_id", "first_name", "status_cd"],
    "loans": ["loan_id", "member_id", "days_past_due", "status_cd"],
    "accounts": ["account_id", "member_id", "status_cd"],
}
DOMAINS = {"LOAN": ["CURRENT", "PAID_OFF"], "MEMBER": ["ACTIVE"], "ACCOUNT": ["ACTIVE"]}
ENTITY = {"members": "MEMBER", "loans": "LOAN", "accounts": "ACCOUNT"}


def catalog(spark):
    rows = [(t, c, "INT") for t, columns in CATALOG.items() for c in columns]
    return spark.createDataFrame(rows, "table string, column string, type string")


def verdict(spark, sql):
    rows = spark.createDataFrame([(1, sql)], "draft_id long, sql string")
    return drafts.validate(rows, catalog(spark), DOMAINS, ENTITY).first()


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT m.first_name FROM members m JOIN loans l ON l.member_id = m.member_id",
        "SELECT TOP 10 l.loan_id FROM dbo.loans l",
        "SELECT l.loan_id FROM loans l ORDER BY l.loan_id OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY",
        "SELECT m.first_name FROM members m WHERE m.first_name = 'LIMIT'",
        "SELECT [LIMIT] FROM members -- LIMIT 5",
        "SELECT m.member_id FROM members m WHERE m.status_cd = 'active'",
        "SELECT l.loan_id FROM loans l JOIN members m ON m.member_id = l.member_id WHERE l.status_cd = 'ACTIVE'",
        "SELECT w.anything FROM warehouses w",
    ],
)
def test_clean(spark, sql):
    assert verdict(spark, sql).errors == []


@pytest.mark.parametrize(
    "sql, part",
    [
        ("", "Empty SQL input."),
        (" \n", "Empty SQL input."),
        ("SELECT l.loan_id FROM loans l LIMIT 5", "LIMIT is not valid"),
        ("SELECT l.loan_id::INT FROM loans l", "'::' cast"),
        ("SELECT `loan_id` FROM loans", "tokenize"),
        ("SELECT l.first_name FROM loans l", "Unknown column: first_name"),
        ("SELECT lost.member_id FROM members m", "'lost.member_id' could not be resolved"),
        ("SELECT l.loan_id FROM loans l WHERE l.status_cd = 'INACTIVE'", "any entity domain"),
        ("SELECT l.loan_id FROM loans l WHERE l.status_cd NOT IN ('CURRENT', 'GONE')", "'GONE'"),
        ("SELECT l.loan_id FROM loans l WHERE 'ACTIVE' <> l.status_cd", "for loan query"),
    ],
)
def test_errors(spark, sql, part):
    found = verdict(spark, sql)
    assert not found.ok and part in " ".join(found.errors)


def test_dialect_error_stops_the_other_checks(spark):
    found = verdict(spark, "SELECT l.first_name FROM loans l WHERE l.status_cd = 'GONE' LIMIT 1")
    assert len(found.errors) == 1


def test_references_to_local_names_are_warnings(spark):
    found = verdict(spark, "WITH recent AS (SELECT l.member_id FROM loans l) SELECT recent.x FROM recent")
    assert found.ok and found.warnings == ["Could not fully validate columns (warning): recent.x"]


def refs(spark, sql):
    rows = spark.createDataFrame([(1, sql)], "draft_id long, sql string")
    row = drafts.references(rows).first()
    return sorted(row.tables), sorted(row.columns)


def test_reference_extraction(spark):
    tables, columns = refs(
        spark,
        "WITH latest AS (SELECT lsh.loan_id FROM loans lsh) SELECT mem.first_name, latest.loan_id, sub.n FROM [dbo].[members] AS mem "
        "JOIN latest ON latest.loan_id = mem.member_id JOIN (SELECT member_id FROM accounts GROUP BY member_id) sub "
        "ON sub.member_id = mem.member_id WHERE mem.first_name = 'from nowhere'",
    )
    assert tables == ["accounts", "loans", "members"]
    assert {"first_name", "loan_id", "member_id"} <= set(columns)
    assert refs(spark, "") == ([], []) and refs(spark, None) == ([], [])


def score(spark, sql, explanation, tables, columns=()):
    kinds = "draft_id long, sql string, explanation string, expected_tables array<string>, expected_columns array<string>"
    rows = spark.createDataFrame([(1, sql, explanation, list(tables), list(columns))], kinds)
    row = scoring.score_answers(rows, catalog(spark)).first()
    return row.score, row.reason


@pytest.mark.parametrize(
    "sql, explanation, tables, columns, expected",
    [
        ("SELECT m.member_id FROM members m", "", ["members"], [], 1.0),
        ("SELECT m.member_id FROM members m", "", ["Members", "loans"], [], 0.5),
        ("SELECT a.account_id FROM accounts a", "", ["members"], [], 0.0),
        ("SELECT x.y FROM loan_summary x", "", ["loans"], [], 0.0),
        ("SELECT m.credit_score FROM members m", "", ["members"], [], 0.0),
        ("SELECT m.member_id FROM members m", "", ["members"], ["credit_score"], 0.0),
        ("", "Use the members table.", ["members"], [], 1.0),
        ("", "Use the members table.", ["members", "loans"], [], 0.5),
        ("", "Use the membership table.", ["member"], [], 0.0),
        ("SELECT m.member_id FROM members m", "", [], [], 0.0),
        ("", "I can’t answer that.", [], [], 1.0),
        ("", "Sure.", [], [], 0.0),
        (None, None, [], [], 0.0),
    ],
)
def test_score_cascade(spark, sql, explanation, tables, columns, expected):
    assert score(spark, sql, explanation, tables, columns)[0] == expected


def test_score_reasons(spark):
    assert score(spark, "SELECT a.b FROM zeta a JOIN alpha c ON a.b = c.d", "", ["loans"])[1] == "Hallucinated table names: alpha, zeta"
    partial = score(spark, "SELECT m.member_id FROM members m", "", ["members", "loans"])
    assert partial[1] == "Partial match — found ['members'], missing ['loans']"


def test_first_fenced_block(spark):
    replies = ["a\n```sql\nSELECT 1\n```\nb\n```\nSELECT 2\n```", "```\n SELECT 3 ```", "```SQL\nSELECT 4\n```", "no fence", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    found = [r.s for r in rows.orderBy("i").select(first_fenced_block(F.col("r")).alias("s")).collect()]
    assert found == ["SELECT 1", "SELECT 3", "SELECT 4", "", ""]


def test_gate_fails_open(spark):
    answers = spark.createDataFrame([(1, "SELECT 1"), (2, "")], "draft_id long, sql string")
    none = spark.createDataFrame([], "draft_id long, ok boolean, errors array<string>, warnings array<string>")
    rows = {r.draft_id: r for r in drafts.gate(answers, none).collect()}
    assert rows[1].ok and rows[1].warnings == ["validator did not run"]
    assert rows[2].ok and rows[2].warnings == []


def test_reply_lists_errors(spark):
    kinds = "explanation string, ok boolean, errors array<string>"
    rows = spark.createDataFrame([("text", False, ["e1", "e2"]), ("fine", True, [])], kinds)
    texts = [r.reply for r in assembly.replies(rows).collect()]
    assert texts[0].startswith("text") and texts[0].endswith("> - e1\n> - e2") and texts[1] == "fine"


def test_names_are_found_once(spark):
    rows = spark.createDataFrame(
        [(i, q, "", ["loans"], ["loan_id"]) for i, q in enumerate(("SELECT l.loan_id FROM loans l", "SELECT x.y FROM nowhere n", ""))],
        "draft_id long, sql string, explanation string, expected_tables array<string>, expected_columns array<string>",
    )
    # Both sides of the join read what was found: no plan searches a text again.
    for found in (drafts.validate(rows, catalog(spark), DOMAINS, ENTITY), scoring.score_answers(rows, catalog(spark))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "regexp_extract_all" not in plan
        assert found.count() == 3


def test_the_first_dialect_error_and_codes_of_any_case(spark):
    texts = ["a::b limit 1", "limit 1 :: x", "`a` limit", "'limit' [::] --limit", None, "where STATUS_CD = 'A'", "status = 'A'"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i")
    found = rows.select(drafts.dialect_error(F.col("t")).alias("e"), drafts.code_literals(F.col("t")).alias("c")).collect()
    assert [r.e and r.e[:12] for r in found[3:]] == [None] * 4 and found[0].e != found[1].e and len({r.e for r in found[:3]}) == 3
    assert [r.c for r in found] == [[], [], [], [], None, ["A"], []]
