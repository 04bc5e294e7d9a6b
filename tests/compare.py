"""Run a registered query next to its DuckDB statement and compare all rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_frame, con, sql: str) -> list[str]:
    """Empty when both sides hold the same rows under the same column names."""
    mine = [tuple(r) for r in spark_frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_frame.columns) != sorted(names):
        return [f"columns {sorted(spark_frame.columns)} != {sorted(names)}"]
    a, b = _bag(spark_frame.columns, mine), _bag(names, theirs)
    found = [f"rows {len(mine)} vs {len(theirs)}"] if len(mine) != len(theirs) else []
    found += [f"only spark: {row}" for row in list((a - b))[:3]]
    found += [f"only duckdb: {row}" for row in list((b - a))[:3]]
    return found
