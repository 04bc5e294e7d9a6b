"""Registered refresh, sink and index queries; the documents are the corpus.

Two corpus snapshots are derived from the documents: between the old and the
new one some are added, removed, changed or kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import index, refresh, search, snapshots
from gleaner.plans import retrieval
from gleaner.plans.fixtures import answers
from gleaner.plans.retrieval import build_index
from gleaner.session import broadcast_parts, new_folder, write_table
from gleaner.sources import sinks
from gleaner.sources.tables import Tables, benchmark_questions, named_documents
from gleaner.streaming import refresh as stream


def _docs(spark, folder):
    return named_documents(Tables(spark, folder).documents)


def snapshot_old(docs):
    return docs.where(F.col("doc_id") % 10 != 0)


def snapshot_new(docs):
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.where(F.col("doc_id") % 7 != 0).withColumn("text", edited)


def document_versions(docs):
    """Version 1 is the old snapshot; version 2 holds what the new one changes, adds or removes."""
    old, new = snapshot_old(docs), snapshot_new(docs)
    first = old.select("doc_id", F.lit(1).cast("long").alias("version"), "file_name", "text", F.lit(False).alias("deleted"))
    changes = write_table(snapshots.corpus_diff(snapshots.document_hashes(old), snapshots.document_hashes(new)), "changes")
    gone, there = changes.where("change = 'removed'"), changes.where("change <> 'removed'")
    second = gone.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("file_name", "text")], F.lit(True).alias("deleted"))
    for part in broadcast_parts(there, "doc_id"):
        second = second.unionByName(new.join(part.select("doc_id"), "doc_id").select("doc_id", "file_name", "text", F.lit(False).alias("deleted")))
    second = second.select("doc_id", F.lit(2).cast("long").alias("version"), "file_name", "text", "deleted")
    return first, second


def corpus_fingerprint(spark, folder):
    return snapshots.fingerprint(snapshots.document_hashes(_docs(spark, folder)), "tfidf")


def corpus_diff(spark, folder):
    docs = _docs(spark, folder)
    return snapshots.corpus_diff(snapshots.document_hashes(snapshot_old(docs)), snapshots.document_hashes(snapshot_new(docs)))


def _state_of(docs):
    return snapshots.fingerprint(snapshots.document_hashes(docs)).first().fingerprint


def refresh_decision(spark, folder):
    docs = _docs(spark, folder)
    current = snapshots.fingerprint(snapshots.document_hashes(snapshot_new(docs)))
    return snapshots.decision(current, _state_of(snapshot_old(docs))).select("action", "tables_found")


def refresh_idempotent(spark, folder):
    """Two refresh cycles over one corpus: the first builds, the second skips."""
    docs, path = _docs(spark, folder), new_folder(spark, "refresh")
    for _ in range(2):
        refresh.run_cycle(docs, path)
    log = spark.read.json(f"{path}/refresh_log")
    return log.select("action", "tables_found")


def refresh_state(spark, folder):
    """The saved fingerprint is the one of the corpus it was saved for."""
    docs, path = _docs(spark, folder), new_folder(spark, "state")
    before = refresh.load_state(spark, path)
    refresh.save_state(spark, path, _state_of(snapshot_old(docs)))
    refresh.save_state(spark, path, _state_of(docs))
    saved = refresh.load_state(spark, path)
    current = snapshots.fingerprint(snapshots.document_hashes(docs))
    return current.select(
        F.lit(before).alias("before"), (F.col("fingerprint") == saved).alias("is_current"), "n_docs"
    )


def _streamed(spark, folder):
    """The stream runs once over the first versions and once more when the second arrive."""
    home = new_folder(spark, "stream")
    for rows in document_versions(_docs(spark, folder)):
        rows.write.mode("append").parquet(f"{home}/versions")
        stream.refresh_stream(spark, f"{home}/versions", f"{home}/index").awaitTermination()
    return f"{home}/index"


def refresh_stream_once(spark, folder):
    home = _streamed(spark, folder)
    words = stream.live_postings(spark, home).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens")
    )
    live = stream.live_documents(spark, home)
    return live.join(words, "doc_id", "left").select(
        "doc_id", "version", "sha", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")
    )


def stream_search(spark, folder):
    """BM25 over the index of what the stream left live."""
    live = stream.live_index(spark, _streamed(spark, folder))
    return retrieval.ranked(search.bm25_topk(benchmark_questions(Tables(spark, folder).benchmark), live))


def refresh_log(spark, folder):
    log = spark.read.json(f"{_streamed(spark, folder)}/log")
    return log.select(F.col("batch").cast("long").alias("batch"), "action", "docs_changed", "docs_removed", "tables_found")


def index_build(spark, folder):
    """Rows of the four index tables after a full build."""
    built, chunks = build_index(spark, folder)
    count = F.count(F.lit(1)).alias("n_rows")
    tables = {"docs": built.docs, "postings": built.postings, "terms": built.terms, "corpus": built.corpus}
    rows = None
    for name, table in tables.items():
        one = table.agg(count).select(F.lit(name).alias("index_table"), "n_rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("chunks", F.lit(chunks).cast("long"))


def index_guard(spark, folder):
    """Reading a missing index and building from no documents are errors; a real one answers."""
    docs, path = _docs(spark, folder), new_folder(spark, "guard")
    outcomes = []
    for name, attempt in (
        ("read_missing", lambda: index.read_index(spark, path)),
        ("build_empty", lambda: index.build_index(docs.where(F.lit(False)), path)),
    ):
        try:
            attempt()
            outcomes.append((name, "accepted"))
        except RuntimeError:
            outcomes.append((name, "refused"))
    index.build_index(docs, path)
    n_docs = index.read_index(spark, path).docs.agg(F.count(F.lit(1)).alias("n_docs"))
    checks = spark.createDataFrame(outcomes, "check string, outcome string")
    found = n_docs.select(F.lit("read_built").alias("check"), F.concat(F.col("n_docs").cast("string"), F.lit(" documents")).alias("outcome"))
    return checks.unionByName(found)


def query_log(spark, folder):
    """Answer records appended as JSON lines and read back: no raw chunks, nulls kept."""
    path = new_folder(spark, "query-log")
    rows = answers(Tables(spark, folder).orders).select(
        F.lit("2024-01-01T00:00:00+00:00").alias("timestamp"),
        F.concat(F.lit("request "), F.col("question_no").cast("string")).alias("question"),
        (F.col("mode") == "rag").alias("rag_enabled"), "explanation", "model", "latency_ms",
        F.transform("expected_tables", lambda t: F.concat(t, F.lit(".md"))).alias("citations"),
        F.array("explanation").alias("raw_chunks"),
        F.lit(None).cast("double").alias("eval_score"), F.lit(None).cast("string").alias("eval_reason"),
    )
    for mode in (True, False):
        sinks.append_log(rows.where(F.col("rag_enabled") == mode), path)
    lines = spark.read.text(path)
    record = F.from_json("value", "model string, rag_enabled boolean, latency_ms long, citations array<string>")
    return lines.select(
        record.alias("r"),
        F.contains("value", F.lit('"eval_score":null')).alias("null_kept"),
        F.contains("value", F.lit('"raw_chunks"')).alias("chunks_kept"),
    ).groupBy("r.model", "r.rag_enabled", "null_kept", "chunks_kept").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("r.latency_ms").alias("latency_ms"),
        F.sum(F.size("r.citations")).alias("n_citations"),
    )


def question_set(spark, folder):
    """Questions written as JSON lines, some without their lists, and read with the fixed schema."""
    path = new_folder(spark, "questions")
    tables = F.when(F.col("item_id") % 3 != 0, F.array(F.concat(F.lit("table_"), (F.col("item_id") % 7).cast("string"))))
    columns = F.when(F.col("item_id") % 4 != 0, F.array(F.lit("a"), F.lit("b")))
    Tables(spark, folder).benchmark.select(
        F.col("item_id").alias("question_no"), F.col("text").alias("question"),
        tables.alias("expected_tables"), columns.alias("expected_columns"),
    ).write.json(path)
    rows = sinks.read_question_set(spark, path)
    return rows.select(
        "question_no", F.md5("question").alias("question_md5"), F.array_join("expected_tables", ",").alias("expected_tables"),
        F.size("expected_columns").cast("long").alias("n_columns"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        corpus_fingerprint, corpus_diff, refresh_decision, refresh_idempotent, refresh_state, refresh_stream_once,
        stream_search, refresh_log, index_build, index_guard, query_log, question_set,
    )
}

_DOCS = """docs AS (
  SELECT doc_id, 'doc_' || doc_id || '.md' AS file_name, text FROM documents WHERE regexp_matches(text, '\\S')
)"""
_SNAPSHOTS = "WITH " + _DOCS + """, old AS (
  SELECT doc_id, text, sha256(file_name || chr(10) || text) AS sha FROM docs WHERE doc_id % 10 <> 0
), edited AS (
  SELECT doc_id, file_name, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END AS text FROM docs WHERE doc_id % 7 <> 0
), new AS (SELECT doc_id, text, sha256(file_name || chr(10) || text) AS sha FROM edited),
diff AS (
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id,
    CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM old o FULL JOIN new n ON o.doc_id = n.doc_id WHERE o.sha IS DISTINCT FROM n.sha
)"""
_LANES = " || '|' || ".join(
    f"sum(CAST('0x' || substr(sha, {1 + 8 * lane}, 8) AS BIGINT))::VARCHAR" for lane in range(snapshots.LANES)
)
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
ORACLES = {
    "corpus_fingerprint": f"""WITH {_DOCS}, hashed AS (SELECT sha256(file_name || chr(10) || text) AS sha FROM docs)
        SELECT count(*) AS n_docs, sha256('tfidf|' || count(*) || '|' || {_LANES}) AS fingerprint FROM hashed""",
    "corpus_diff": _SNAPSHOTS + " SELECT doc_id, change FROM diff",
    "refresh_decision": _SNAPSHOTS + """ SELECT CASE WHEN (SELECT count(*) FROM diff) = 0 THEN 'skipped' ELSE 'reindexed' END AS action,
        (SELECT count(*) FROM new) AS tables_found""",
    "refresh_idempotent": f"WITH {_DOCS} SELECT action, (SELECT count(*) FROM docs) AS tables_found FROM (VALUES ('reindexed'), ('skipped')) AS t(action)",
    "refresh_state": f"WITH {_DOCS} SELECT '' AS before, true AS is_current, count(*) AS n_docs FROM docs",
    "refresh_stream_once": _SNAPSHOTS + f""" SELECT doc_id, (CASE WHEN change IS NULL THEN 1 ELSE 2 END)::BIGINT AS version, sha,
        len(list_distinct({_WORDS})) AS n_terms, len({_WORDS}) AS n_tokens FROM new LEFT JOIN diff USING (doc_id)""",
    "stream_search": "WITH all_" + _DOCS + """, docs AS (
          SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' edited' ELSE text END AS text FROM all_docs WHERE doc_id % 7 <> 0
        )""" + retrieval.INDEX_OF_DOCS + retrieval.asked_sql() + retrieval.BM25 + retrieval.TOP + "bm25_top",
    "refresh_log": _SNAPSHOTS + """ SELECT 0::BIGINT AS batch, 'reindexed' AS action, count(*) AS docs_changed, 0::BIGINT AS docs_removed, count(*) AS tables_found FROM old
        UNION ALL SELECT 1::BIGINT, 'reindexed', count(*) FILTER (WHERE change <> 'removed'), count(*) FILTER (WHERE change = 'removed'),
          (SELECT count(*) FROM new) FROM diff""",
    "index_build": f"""WITH {_DOCS}, words AS (SELECT doc_id, unnest({_WORDS}) AS term FROM docs)
        SELECT index_table, n_rows, (SELECT count(*) FROM docs) AS chunks FROM (
          SELECT 'docs' AS index_table, count(*) AS n_rows FROM docs UNION ALL SELECT 'corpus', 1
          UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT doc_id, term FROM words)
          UNION ALL SELECT 'terms', count(DISTINCT term) FROM words)""",
    "index_guard": f"""WITH {_DOCS} SELECT 'read_missing' AS "check", 'refused' AS outcome UNION ALL SELECT 'build_empty', 'refused'
        UNION ALL SELECT 'read_built', count(*) || ' documents' FROM docs""",
    "query_log": """SELECT 'm' || ((o_orderkey // 40) % 5) AS model, (o_orderkey // 20) % 2 = 0 AS rag_enabled, true AS null_kept,
          false AS chunks_kept, count(*) AS n_records, sum(o_orderkey * 37 % 4000 + 500)::BIGINT AS latency_ms,
          sum(CASE o_orderkey % 20 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 7 THEN 2 WHEN 14 THEN 2 WHEN 15 THEN 2 WHEN 18 THEN 2
            WHEN 16 THEN 0 WHEN 17 THEN 0 WHEN 19 THEN 0 ELSE 1 END)::BIGINT AS n_citations
        FROM orders GROUP BY ALL""",
    "question_set": """SELECT item_id AS question_no, md5(text) AS question_md5,
        CASE WHEN item_id % 3 <> 0 THEN 'table_' || (item_id % 7) ELSE '' END AS expected_tables,
        (CASE WHEN item_id % 4 <> 0 THEN 2 ELSE 0 END)::BIGINT AS n_columns FROM benchmark""",
}
