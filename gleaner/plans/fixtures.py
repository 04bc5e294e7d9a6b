"""A table of answers with SQL drafts, one per order, and the fixed tables they are checked by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = {
    "region": {"r_regionkey": "INT", "r_name": "VARCHAR(100)"},
    "nation": {"n_nationkey": "INT", "n_name": "VARCHAR(100)", "n_regionkey": "INT"},
    "customer": {
        "c_custkey": "INT", "c_name": "VARCHAR(100)", "c_nationkey": "INT", "c_acctbal": "DECIMAL(15,2)",
        "c_mktsegment": "VARCHAR(20)", "status_cd": "VARCHAR(10)",
    },
    "supplier": {"s_suppkey": "INT", "s_name": "VARCHAR(100)", "s_nationkey": "INT", "s_acctbal": "DECIMAL(15,2)"},
    "part": {
        "p_partkey": "INT", "p_name": "VARCHAR(100)", "p_brand": "VARCHAR(20)", "p_type": "VARCHAR(20)",
        "p_size": "INT", "p_retailprice": "DECIMAL(15,2)",
    },
    "orders": {
        "o_orderkey": "INT", "o_custkey": "INT", "o_orderstatus": "CHAR(2)", "o_totalprice": "DECIMAL(15,2)",
        "o_orderdate": "DATETIME", "o_orderpriority": "VARCHAR(20)", "status_cd": "VARCHAR(10)",
    },
    "lineitem": {
        "l_orderkey": "INT", "l_partkey": "INT", "l_suppkey": "INT", "l_linenumber": "INT",
        "l_quantity": "DECIMAL(15,2)", "l_extendedprice": "DECIMAL(15,2)", "l_discount": "DECIMAL(5,4)",
        "l_tax": "DECIMAL(5,4)", "l_returnflag": "CHAR(2)", "l_linestatus": "CHAR(2)", "l_shipdate": "DATETIME",
        "status_cd": "VARCHAR(10)",
    },
}
DOMAINS = {"ORDER": ["F", "O", "P"], "LINE": ["F", "O"], "CUSTOMER": ["ACTIVE"]}
TABLE_ENTITY = {"orders": "ORDER", "lineitem": "LINE", "customer": "CUSTOMER"}

# kind -> (draft with {k} for the order key, fence, expected tables, expected columns)
DRAFTS = {
    0: ("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey = {k}", "sql", ["customer"], ["c_custkey"]),
    1: (
        "SELECT cus.c_name, ord.o_orderkey FROM customer cus JOIN orders ord ON cus.c_custkey = ord.o_custkey "
        "WHERE ord.o_orderkey = {k}", "sql", ["customer", "orders"], ["c_name", "o_orderkey"],
    ),
    2: (
        "SELECT l.l_orderkey FROM lineitem l JOIN customer c ON l.c_custkey = c.c_custkey WHERE l.l_orderkey = {k}",
        "sql", ["lineitem", "customer", "orders"], ["l_orderkey"],
    ),
    3: ("SELECT c.c_custkey, c.credit_score FROM customer c WHERE c.c_custkey = {k}", "SQL", ["customer"], []),
    4: ("SELECT * FROM order_delinquency_summary WHERE days_past_due > {k}", "sql", ["orders"], []),
    5: ("SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey > {k} LIMIT 10", "sql", ["orders"], ["o_orderkey"]),
    6: ("SELECT o.o_orderkey::VARCHAR FROM orders o WHERE o.o_orderkey = {k}", "", ["orders"], ["o_orderkey"]),
    7: ("SELECT `o_orderkey` FROM orders WHERE o_orderkey = {k}", "sql", ["orders", "lineitem"], []),
    8: ("SELECT TOP 10 o.o_orderkey FROM orders o WHERE o.o_orderkey > {k}", "sql", ["orders"], ["o_orderkey"]),
    9: (
        "SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey > {k} ORDER BY o.o_orderkey "
        "OFFSET 0 ROWS FETCH NEXT 10 ROWS ONLY", "", ["orders"], ["o_orderkey", "order_score"],
    ),
    10: ("SELECT c.c_name FROM dbo.customer c WHERE c.c_name = 'LIMIT' AND c.c_custkey = {k}", "sql", ["customer"], ["c_name"]),
    11: ("SELECT o.o_orderkey FROM orders o WHERE o.status_cd = 'INACTIVE' AND o.o_orderkey = {k}", "sql", ["orders"], []),
    12: ("SELECT o.o_orderkey FROM orders o WHERE o.status_cd IN ('F', 'INACTIVE') AND o.o_orderkey = {k}", "sql", ["orders"], []),
    13: ("SELECT l.l_orderkey FROM lineitem l WHERE 'P' = l.status_cd AND l.l_orderkey = {k}", "sql", ["lineitem"], []),
    14: (
        "SELECT c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.status_cd <> 'p' "
        "AND o.o_orderkey = {k}", "sql", ["customer", "orders"], [],
    ),
    15: (
        "WITH latest AS (SELECT o.o_custkey, MAX(o.o_orderdate) AS last_date FROM orders o GROUP BY o.o_custkey) "
        "SELECT cus.c_name, latest.o_custkey FROM [dbo].[customer] AS cus JOIN latest ON latest.o_custkey = cus.c_custkey "
        "JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) sub ON sub.o_custkey = cus.c_custkey "
        "WHERE cus.c_custkey = {k}", "sql", ["customer", "orders"], ["c_name"],
    ),
    16: ("I apologize, but the schema does not include what request {k} needs.", None, [], []),
    17: ("I can’t answer that. Request {k} is open.", None, [], []),
    18: ("You should use the customer table for request {k}.", None, ["customer", "orders"], []),
    19: ("SELECT c.c_name FROM customer c WHERE x.c_custkey = {k}", "sql", [], []),
}
FENCED = "Here is a draft.\n```{tag}\n{sql}\n```\nIt reads the tables named in it."


def _answer(kind: int) -> tuple[str, str]:
    """Text before and after the order key."""
    sql, fence, *_ = DRAFTS[kind]
    text = sql if fence is None else FENCED.format(tag=fence, sql=sql)
    before, after = text.split("{k}")
    return before, after


def answers(orders: DataFrame) -> DataFrame:
    """One answer per order: 20 kinds, two modes, five models, five trials.

    Fifty answers share a question: one per mode, model and trial.
    """
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 20
    answer, tables, columns = F.lit(None), F.lit(None), F.lit(None)
    for number in DRAFTS:
        before, after = _answer(number)
        _, _, expected_tables, expected_columns = DRAFTS[number]
        text = F.concat(F.lit(before), key.cast("string"), F.lit(after))
        answer = F.when(kind == number, text).otherwise(answer)
        tables = F.when(kind == number, F.array(*map(F.lit, expected_tables)).cast("array<string>")).otherwise(tables)
        columns = F.when(kind == number, F.array(*map(F.lit, expected_columns)).cast("array<string>")).otherwise(columns)
    return orders.select(
        key.alias("draft_id"),
        kind.alias("kind"),
        F.when(F.floor(key / 20) % 2 == 0, "rag").otherwise("no_rag").alias("mode"),
        F.concat(F.lit("m"), (F.floor(key / 40) % 5).cast("string")).alias("model"),
        (F.floor(key / 200) % 5).alias("trial"),
        (F.floor(key / 1000) * 20 + kind).alias("question_no"),
        (key * 37 % 4000 + 500).alias("latency_ms"),
        answer.alias("explanation"),
        tables.alias("expected_tables"),
        columns.alias("expected_columns"),
    )


def catalog_rows(spark: SparkSession) -> DataFrame:
    rows = [(table, column, kind) for table, columns in CATALOG.items() for column, kind in columns.items()]
    return spark.createDataFrame(rows, "table string, column string, type string")


def text_literal(text: str) -> str:
    """A DuckDB literal; line breaks become chr(10)."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(text_literal(v) for v in values) + "]::VARCHAR[]"


def answers_sql() -> str:
    """The same answers for DuckDB, as the body of a CTE."""

    def case(values: dict[int, str]) -> str:
        return "CASE o_orderkey % 20 " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + " END"

    texts = {}
    for number in DRAFTS:
        before, after = _answer(number)
        texts[number] = f"{text_literal(before)} || o_orderkey || {text_literal(after)}"
    return f"""SELECT o_orderkey AS draft_id, o_orderkey % 20 AS kind,
      CASE WHEN (o_orderkey // 20) % 2 = 0 THEN 'rag' ELSE 'no_rag' END AS mode,
      'm' || ((o_orderkey // 40) % 5) AS model, (o_orderkey // 200) % 5 AS trial,
      (o_orderkey // 1000) * 20 + o_orderkey % 20 AS question_no, o_orderkey * 37 % 4000 + 500 AS latency_ms,
      {case(texts)} AS explanation,
      {case({n: _list(d[2]) for n, d in DRAFTS.items()})} AS expected_tables,
      {case({n: _list(d[3]) for n, d in DRAFTS.items()})} AS expected_columns
    FROM orders"""


def catalog_sql() -> str:
    rows = ", ".join(f"('{t}', '{c}', '{k}')" for t, columns in CATALOG.items() for c, k in columns.items())
    return f'(VALUES {rows}) AS catalog("table", "column", "type")'
