import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner import session
from gleaner.functions import tsql
from gleaner.operators import conversation, index, metadata, ordered, refresh, snapshots, warehouse
from gleaner.session import new_folder
from gleaner.sources import sinks
from gleaner.sources.tables import Tables
from gleaner.streaming import refresh as stream

TURNS = "conv_id long, turn long, role string, text string"


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(rows)], TURNS)


def test_split_takes_the_last_user_message(spark):
    said = turns(spark, ("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "after"))
    rows = conversation.split_messages(said).orderBy("part", "turn").collect()
    assert [(r.part, r.text) for r in rows] == [("history", "u1"), ("history", "a1"), ("question", "u2")]


def test_no_user_turn(spark):
    said = turns(spark, ("system", "s"), ("assistant", "a"))
    assert [tuple(r) for r in conversation.split_messages(said).collect()] == [(1, "question", -1, "user", "")]
    assert conversation.retrieval_queries(said).first().query == ""


def test_history_is_trimmed_and_skips_empty_texts(spark):
    said = turns(spark, *[("user", f"u{i}") for i in range(8)], ("assistant", ""), ("assistant", None), ("user", "q"))
    kept = [r.text for r in conversation.trim_history(said).orderBy("turn").collect()]
    assert kept == [f"u{i}" for i in range(2, 8)]
    assert conversation.retrieval_queries(said).first().query == "u7\nq"
    content = spark.createDataFrame([(1, "c")], "conv_id long, content string")
    messages = conversation.assemble_messages(said, content, "sys").first().messages
    assert [m.role for m in messages] == ["system"] + ["user"] * 7
    assert messages[-1].content == "c"


@pytest.mark.parametrize(
    "text, is_task",
    [("### Task:\nname it", True), ("Create a concise, 3-5 word title", True), ("a concise list", False), ("", False)],
)
def test_task_prompts(spark, text, is_task):
    assert spark.range(1).select(conversation.is_task(F.lit(text)).alias("t")).first().t is is_task


def test_routes(spark):
    rows = spark.createDataFrame(
        [("x", "### task: a"), ("m", "### task: a"), ("m", " "), (None, "how many?")], "model string, question string"
    )
    assert [r.route for r in conversation.route(rows, "m").collect()] == ["unknown_model", "canned_reply", "no_question", "pipeline"]


def test_chunked_windows_equal_single_windows_for_a_hot_key(spark):
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, 0) + make_dt_interval(id div 40, id % 24)")
    rows = spark.range(400).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), day.alias("ts"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("decimal(15,2)")).alias("v"),
    )
    window = Window.partitionBy("k").orderBy("ts", "id")
    chunk = F.to_date("ts")
    total = ordered.running_total(rows, "k", ["ts", "id"], "v", chunk=chunk).select("id", F.coalesce("balance", F.lit(0)).alias("b"))
    plain = rows.select("id", F.coalesce(F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("b"))
    assert total.exceptAll(plain).count() == 0 and total.count() == 400
    near = ordered.neighbours(rows, "k", ["ts", "id"], chunk=chunk, following={"n": "v"}, preceding={"p": "v"}).select("id", "n", "p")
    single = rows.select("id", F.lead("v").over(window).alias("n"), F.lag("v").over(window).alias("p"))
    assert near.exceptAll(single).count() == 0 and near.count() == 400


def test_datediff_counts_boundaries(spark):
    a, b = F.lit(datetime.date(2023, 12, 31)), F.lit(datetime.date(2024, 1, 1))
    row = spark.range(1).select(*(tsql.datediff(u, a, b).alias(u) for u in ("year", "quarter", "month", "day"))).first()
    assert tuple(row) == (1, 1, 1, 1)
    # A Sunday begins a week; an hour is crossed within a minute.
    weeks = spark.range(1).select(tsql.datediff("week", a, b), tsql.datediff("week", F.lit(datetime.date(2023, 12, 30)), a)).first()
    assert tuple(weeks) == (0, 1)
    late, early = (F.to_timestamp(F.lit(f"2024-01-01 {t}")) for t in ("09:59:59", "10:00:01"))
    units = ("hour", "minute", "second")
    assert tuple(spark.range(1).select(*(tsql.datediff(u, late, early) for u in units)).first()) == (1, 1, 2)
    moved = spark.range(1).select(*(F.date_format(tsql.dateadd(u, -2, early), "HH:mm:ss") for u in units)).first()
    assert tuple(moved) == ("08:00:01", "09:58:01", "09:59:59")


DOCUMENT = """# TABLE: codes

| not | here |
## Columns

| Column | Type | Nullable | Description | Example |
|---|---|---|---|---|
| code_id | INT | NOT NULL | key | 1 |
| Description | VARCHAR(255) | NULL | text | — |
| two words | INT | NULL | prose | — |
| code_id | BIGINT | NOT NULL | again | 1 |

## Sample rows
| other | INT |
"""


def test_catalog_parsing(spark):
    docs = spark.createDataFrame([("Codes", DOCUMENT), ("empty", "no sections"), ("crlf", DOCUMENT.replace("\n", "\r\n"))], "table_name string, text string")
    rows = {tuple(r) for r in metadata.parse_catalog(docs).collect()}
    expected = {("code_id", "BIGINT"), ("description", "VARCHAR(255)")}
    assert rows == {(t, c, k) for t in ("codes", "crlf") for c, k in expected}


def hashed(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, file_name string, text string")
    return snapshots.document_hashes(frame)


def test_fingerprint(spark):
    rows = [(i, f"d{i}.md", f"text {i}") for i in range(50)]
    digest = lambda frame, settings="": snapshots.fingerprint(frame, settings).first().fingerprint
    base = digest(hashed(spark, rows))
    assert digest(hashed(spark, rows[::-1]).repartition(7)) == base
    assert digest(hashed(spark, rows[:-1])) != base
    assert digest(hashed(spark, [(0, "d0.md", "text 0!")] + rows[1:])) != base
    assert digest(hashed(spark, rows), "other vectors") != base
    assert digest(hashed(spark, [])) != base


def test_refresh_cycle(spark):
    path = new_folder(spark, "refresh")
    docs = lambda *texts: spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_id long, file_name string, text string")
    assert refresh.load_state(spark, path) == ""
    actions = [refresh.run_cycle(docs(*texts), path) for texts in (("a b", "c"), ("a b", "c"), ("a b", "d"))]
    assert actions == ["reindexed", "skipped", "reindexed"]


def test_late_versions_are_told_by_all_that_came_before(spark):
    home = new_folder(spark, "stream")
    batches = [
        [(1, 1, "a", "one", False), (2, 1, "b", "two", False)],
        [(1, 3, "a", None, True), (2, 3, "b", "two", False), (3, 3, "c", None, True)],
        [(1, 2, "a", "late", False), (2, 2, "b", "late", False), (3, 2, "c", "late", False)],
        [(1, 4, "a", "back", False)],
    ]
    for batch, rows in enumerate(batches):
        stream.apply_versions(spark.createDataFrame(rows, stream.VERSIONS), batch, home)
    log = {r.batch: (r.action, r.docs_changed, r.docs_removed, r.tables_found) for r in spark.read.json(f"{home}/log").collect()}
    assert log == {0: ("reindexed", 2, 0, 2), 1: ("reindexed", 0, 1, 1), 2: ("skipped", 0, 0, 1), 3: ("reindexed", 1, 0, 2)}
    assert {(r.doc_id, r.version) for r in stream.live_documents(spark, home).collect()} == {(1, 4), (2, 3)}
    assert {(r.doc_id, r.term) for r in stream.live_postings(spark, home).collect()} == {(1, "back"), (2, "two")}


def test_texts_of_a_batch_stay_where_they_are(spark, monkeypatch):
    """Changes are told by hashes, in bounded broadcasts; repeated rows of one version count once."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 2)
    home, counts, real = new_folder(spark, "stream"), [], stream.counted_words
    monkeypatch.setattr(stream, "counted_words", lambda docs, **options: counts.append(docs) or real(docs, **options))
    rows = [(i, 1, f"f{i}", f"w{i} w{i} x", False) for i in range(7)]
    rows += [(3, 1, "f3", "w3 w3 x", False), (4, 2, "f4", "new", False), (5, 2, "f5", None, True), (6, None, "f6", "none", False), (7, None, "f7", "a a", False)]
    stream.apply_versions(spark.createDataFrame(rows, stream.VERSIONS), 0, home)
    assert len(counts) > 1
    plans = [docs._jdf.queryExecution().executedPlan().toString() for docs in counts]
    assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)
    assert "text" not in spark.read.parquet(f"{home}/arrived").columns
    words = {(r.doc_id, r.term, r.tf, r.dl) for r in stream.live_postings(spark, home).collect()}
    expected = {(i, w, n, 3) for i in (0, 1, 2, 3, 6) for w, n in ((f"w{i}", 2), ("x", 1))} | {(4, "new", 1, 1), (7, "a", 2, 2)}
    assert words == expected and stream.live_postings(spark, home).count() == len(expected)


def test_live_index_is_a_full_build_and_outlives_compaction(spark):
    home, target = new_folder(spark, "stream"), new_folder(spark, "compact")
    versions = lambda *rows: spark.createDataFrame(rows, stream.VERSIONS)
    stream.apply_versions(versions((1, 1, "a", "x y", False), (2, 1, "b", "z", False), (3, 1, "c", "...", False)), 0, home)
    stream.apply_versions(versions((1, 2, "a", "x w w", False), (2, 2, "b", None, True)), 1, home)
    docs = spark.createDataFrame([(1, "a", "x w w"), (3, "c", "...")], "doc_id long, file_name string, text string")
    path = new_folder(spark, "full")
    assert index.build_index(docs, path, buckets=3) == 2
    full = index.read_index(spark, path)
    stream.compact(spark, home, target)
    for live in (stream.live_index(spark, home, buckets=3), stream.live_index(spark, target, buckets=3)):
        for name in ("docs", "postings", "terms", "corpus"):
            one, other = getattr(live, name), getattr(full, name)
            assert sorted(map(str, one.select(*other.columns).collect())) == sorted(map(str, other.collect())), name
    # The deletion is still known: its late older version is skipped.
    stream.apply_versions(versions((2, 1, "b", "z", False), (4, 1, "d", "v", False)), 2, target)
    assert {r.doc_id for r in stream.live_documents(spark, target).collect()} == {1, 3, 4}


def test_repeated_stream_batch_changes_nothing(spark):
    home = new_folder(spark, "stream")
    versions = lambda *rows: spark.createDataFrame(rows, stream.VERSIONS)
    stream.apply_versions(versions((1, 1, "a", "x y", False), (2, 1, "b", "z", False)), 0, home)
    second = versions((1, 2, "a", "x w w", False), (2, 2, "b", None, True), (3, 1, "c", "v", False), (3, 2, "c", "v u", False))
    for _ in range(2):
        stream.apply_versions(second, 1, home)
    # A late old version is ignored.
    stream.apply_versions(versions((1, 1, "a", "x y", False)), 2, home)
    live = {(r.doc_id, r.version) for r in stream.live_documents(spark, home).collect()}
    assert live == {(1, 2), (3, 2)}
    words = {(r.doc_id, r.term, r.tf) for r in stream.live_postings(spark, home).collect()}
    assert words == {(1, "x", 1), (1, "w", 2), (3, "v", 1), (3, "u", 1)}
    log = spark.read.json(f"{home}/log").orderBy("batch").collect()
    assert [(r.action, r.tables_found) for r in log] == [("reindexed", 2), ("reindexed", 2), ("skipped", 2)]


def test_log_keeps_nulls_and_drops_chunks(spark):
    path = new_folder(spark, "log")
    record = spark.range(1).select(F.lit("q").alias("question"), F.array(F.lit("c")).alias("raw_chunks"), F.lit(None).cast("double").alias("eval_score"))
    for _ in range(2):
        sinks.append_log(record, path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"question":"q","eval_score":null}'] * 2


def test_results_do_not_depend_on_the_number_of_partitions(spark, folder):
    from gleaner.plans import QUERIES

    names = ("running_balance", "validate_drafts", "trim_history")
    before = {n: sorted(map(str, QUERIES[n](spark, folder).collect())) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert before == {n: sorted(map(str, QUERIES[n](spark, folder).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_cross_join_in_registered_plans(spark, folder):
    from gleaner.plans import conversation, drafts, metadata, warehouse

    for module in (warehouse, conversation, drafts, metadata):
        for name, query in module.QUERIES.items():
            plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_date_filters_reach_the_scan(spark, folder):
    from gleaner.plans import QUERIES

    plan = QUERIES["calendar_range"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert Tables(spark, folder).orders.columns


def test_report_files_hold_the_lines_in_order(spark):
    from gleaner.operators import scoring

    rows = spark.createDataFrame(
        [(i, "q" * (50 + i), 1.0, 0.5, "a.md" if i else None, "r") for i in range(9)],
        "question_no long, question string, rag double, no_rag double, citations string, reason string",
    )
    path = new_folder(spark, "report")
    sinks.write_report(scoring.report_lines(rows, "Report"), path)
    lines = [r.value for r in spark.read.text(path).withColumn("f", F.col("_metadata.file_name")).orderBy("f").collect()]
    assert len(lines) == 22 and sorted(lines[13:15])[0].startswith("| 0 | ")
    assert "| 0 | " + "q" * 50 + " | 1.0 | 0.5 | +0.5 | — | r |" in lines
    assert "| 6 | " + "q" * 55 + "… | 1.0 | 0.5 | +0.5 | a.md | r |" in lines
    assert "| RAG enabled | **1.00** |" in lines


def test_current_states_are_the_current_rows_of_the_history(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01", 1, "x"), ("a", "2024-01-01", 2, "y"), ("a", None, 9, "z"), ("b", None, 3, None), (None, "2024-01-02", 4, "x")],
        "who string, at string, id long, state string",
    )
    current = warehouse.current_states(rows, "who", "at", "id", "state")
    assert {tuple(r) for r in current.select("who", "id").collect()} == {("a", 2), ("b", 3), (None, 4)}
    dated = rows.where("who is not null and at is not null")
    history = warehouse.validity_history(dated, "who", "at", "id", "state", chunk=F.col("effective"))
    columns = ["who", "id", "effective", "state"]
    of_history = warehouse.current_rows(history).select(*columns).collect()
    assert of_history == warehouse.current_states(dated, "who", "at", "id", "state").select(*columns).collect()
