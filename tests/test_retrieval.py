import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.functions.text import token_overlap, tokens
from gleaner.operators import dense, fusion, index, search
from gleaner.plans import retrieval
from gleaner.session import new_folder, write_table
from gleaner.sources.sinks import scan_documents
from gleaner.sources.tables import Tables, benchmark_questions, named_documents, vector_corpus


def corpus(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}.md", t) for i, t in enumerate(texts)], "doc_id long, file_name string, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q_id long, question string")


def ranked(spark, *ids):
    return spark.createDataFrame([(0, d, r) for r, d in enumerate(ids, 1)], "q_id long, doc_id long, rank long")


def order(rows):
    return [r.doc_id for r in rows.orderBy("q_id", "rank").collect()]


SCHEMA_TEXTS = (
    "members member_id first_name last_name",
    "loans loan_id principal past due delinquency status",
    "accounts account_id balance opened",
    "cards card_id limit network",
)


def test_tokens(spark):
    row = spark.range(1).select(tokens(F.lit("Member_ID JOIN  Loans!")).alias("t")).first()
    assert row.t == ["member_id", "join", "loans"]


def test_bm25_puts_the_matching_document_first(spark):
    idx = index.plan_index(corpus(spark, *SCHEMA_TEXTS))
    found = search.bm25_topk(asked(spark, "loans past due delinquency principal"), idx)
    assert order(found)[0] == 1


def test_bm25_edges(spark):
    one = index.plan_index(corpus(spark, "loans past due"))
    assert search.bm25_topk(asked(spark, "loans"), one).count() == 0
    idx = index.plan_index(corpus(spark, *SCHEMA_TEXTS))
    assert search.bm25_topk(asked(spark, "?!", ""), idx).count() == 0
    few = search.bm25_topk(asked(spark, "loans members"), idx, k=50)
    assert sorted(order(few)) == [0, 1]


def test_equal_scores_are_ordered_by_document(spark):
    idx = index.plan_index(corpus(spark, "a x", "b y", "b y", "c z", "d w"))
    assert order(search.bm25_topk(asked(spark, "b"), idx)) == [1, 2]


def test_floor_search_finds_the_same_rows(spark, folder):
    t = Tables(spark, folder)
    questions = benchmark_questions(t.benchmark)
    path = new_folder(spark, "index")
    index.build_index(named_documents(t.documents), path)
    idx = index.read_index(spark, path)
    for topk in (search.bm25_topk, search.tfidf_topk):
        plain, pruned = topk(questions, idx), topk(questions, idx, pair_budget=0)
        assert plain.exceptAll(pruned).count() == 0
        assert pruned.exceptAll(plain).count() == 0


def test_blocks_of_documents_give_their_best_rows_only(spark, folder, monkeypatch):
    t = Tables(spark, folder)
    path = new_folder(spark, "index")
    index.build_index(named_documents(t.documents), path)
    questions, idx = benchmark_questions(t.benchmark), index.read_index(spark, path)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 3000)
    monkeypatch.setattr(search, "PART_WORDS", 400)
    found = search.bm25_topk(questions, idx, 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, search.bm25_topk(questions, idx, 3, pair_budget=0).collect()))
    # Pairs of questions and documents are never rows.
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().toString()


def test_blocks_with_odd_documents(spark):
    rows = [(1, "a", "cat dog"), (1, "b", "cat bird"), (None, "c", "cat cat dog"), (None, "d", "dog x"), (5, "e", "fish"), (6, "f", "..."), (7, "g", "eel")]
    idx = index.plan_index(spark.createDataFrame(rows, "doc_id long, file_name string, text string"))
    for questions in (asked(spark, "cat dog fish", "eel", "?", None, "zz"), asked(spark, "?")):
        for topk in (search.bm25_topk, search.tfidf_topk):
            assert sorted(map(str, topk(questions, idx).collect())) == sorted(map(str, topk(questions, idx, pair_budget=0).collect()))


def test_documents_are_not_shuffled_for_a_few_answers(spark, folder):
    for query in (retrieval.context_block, retrieval.prompt_build):
        plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "text" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and "text" in line)
        assert "BroadcastHashJoin [doc_id" in plan


def test_floor_search_with_negative_weights(spark):
    # In two documents that share every word all idf are negative, and so is their mean.
    idx = index.plan_index(corpus(spark, "a b c", "a b c", "a b d"))
    plain = search.bm25_topk(asked(spark, "a b c d"), idx)
    pruned = search.bm25_topk(asked(spark, "a b c d"), idx, pair_budget=0)
    assert plain.collect() == pruned.collect()


def test_rrf(spark):
    both = fusion.rrf_fuse(ranked(spark, 10, 11), ranked(spark, 11, 12))
    assert order(both) == [11, 10, 12]
    alone = fusion.rrf_fuse(ranked(spark, 5, 3, 9), ranked(spark, 1).where("false"))
    assert order(alone) == [5, 3, 9]


def test_ranks_have_no_gaps(spark, folder):
    t = Tables(spark, folder)
    idx = index.plan_index(named_documents(t.documents))
    found = search.bm25_topk(benchmark_questions(t.benchmark), idx)
    bad = found.groupBy("q_id").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("n")).where("m <> n")
    assert bad.count() == 0


def test_rerank(spark):
    eight = ranked(spark, *range(8))
    assert order(fusion.rerank(eight, None, 5)) == [0, 1, 2, 3, 4]
    scores = eight.select("q_id", "doc_id", F.col("doc_id").cast("double").alias("score"))
    assert order(fusion.rerank(eight.where("doc_id < 5"), scores, 3)) == [4, 3, 2]
    assert fusion.rerank(eight.where("false"), scores, 3).count() == 0


def test_overlap_from_postings_is_overlap_from_texts(spark, folder):
    t = Tables(spark, folder)
    docs, questions = named_documents(t.documents), benchmark_questions(t.benchmark)
    idx = index.plan_index(docs)
    pairs = search.bm25_topk(questions, idx, 5)
    stored = fusion.word_overlap(pairs, questions, idx).withColumn("score", F.round("score", 9))
    read = fusion.score_pairs(pairs, questions, docs, token_overlap).withColumn("score", F.round("score", 9))
    assert stored.exceptAll(read).count() == 0 and read.exceptAll(stored).count() == 0


def test_pandas_scorer(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def model(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype(float)

    docs, questions = corpus(spark, "aa", "aaaa", "a"), asked(spark, "q")
    scores = fusion.score_pairs(ranked(spark, 0, 1, 2), questions, docs, model)
    assert order(fusion.rerank(ranked(spark, 0, 1, 2), scores, 2)) == [1, 0]


def test_citations(spark):
    names = spark.createDataFrame([(0, n, r) for r, n in enumerate("abacb", 1)], "q_id long, file_name string, rank long")
    assert fusion.citations(names).first().citations == ["a", "b", "c"]


def brute_force(queries, vectors, k, metric):
    out = {}
    for q_id, q in queries:
        if metric == "l2":
            distances = [(round(float(((q - v) ** 2).sum()), 6), d) for d, v in vectors]
        else:
            distances = [(round(1 - float(q @ v) / float(np.linalg.norm(q) * np.linalg.norm(v)), 6), d) for d, v in vectors]
        out[q_id] = [d for _, d in sorted(distances)[:k]]
    return out


def test_dense_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8)) for i in range(200)] + [(200 + i, np.ones(8)) for i in range(100)]
    queries = [(i, rng.normal(size=8)) for i in range(9)] + [(9, np.ones(8))]
    frame = lambda rows, key: spark.createDataFrame([(i, v.tolist()) for i, v in rows], f"{key} long, vector array<double>")
    for metric in dense.METRICS:
        for block_bytes in (dense.BLOCK_BYTES, 100):
            monkeypatch.setattr(dense, "BLOCK_BYTES", block_bytes)
            found = dense.dense_topk(frame(queries, "q_id"), frame(vectors, "doc_id").repartition(5), 7, metric=metric)
            mine = {}
            for r in found.orderBy("q_id", "rank").collect():
                mine.setdefault(r.q_id, []).append(r.doc_id)
            assert mine == brute_force(queries, vectors, 7, metric)


def vector_frame(spark, rows, key):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{key} long, vector array<double>")


def test_lsh_recall(spark, folder):
    vectors = vector_corpus(Tables(spark, folder).embeddings)
    queries = dense.label_means(vectors).select(F.col("label").cast("long").alias("q_id"), "vector")
    for metric in dense.METRICS:
        exact = dense.dense_topk(queries, vectors, 10, metric=metric)
        near = dense.dense_topk_lsh(queries, vectors, 10, metric=metric)
        assert dense.recall(near, exact).first().recall > 0.8


def test_lsh_on_gaussian_vectors_scores_fewer_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = vector_frame(spark, enumerate(rng.normal(3.0, 1.0, (4000, 64))), "doc_id")
    queries = vector_frame(spark, enumerate(rng.normal(3.0, 1.0, (100, 64))), "q_id")
    near, exact = dense.dense_topk_lsh(queries, vectors, 10), dense.dense_topk(queries, vectors, 10)
    assert dense.recall(near, exact).first().recall >= 0.8
    pairs = dense.lsh_pairs(queries, 100, vectors, 64, 16, 8)
    assert 0 < pairs.count() < 0.5 * 100 * 4000
    assert pairs.distinct().count() == pairs.count()


def test_lsh_gives_k_rows_where_k_vectors_exist(spark):
    rng = np.random.default_rng(6)
    vectors = vector_frame(spark, enumerate(rng.normal(size=(30, 16))), "doc_id")
    queries = vector_frame(spark, [(0, np.full(16, 50.0)), (1, rng.normal(size=16))], "q_id")
    for k, n in ((25, 25), (40, 30)):
        assert {r["count"] for r in dense.dense_topk_lsh(queries, vectors, k).groupBy("q_id").count().collect()} == {n}
    assert dense.dense_topk_lsh(queries.where("false"), vectors, 5).count() == 0
    assert dense.dense_topk_lsh(queries, vectors.where("false"), 5).count() == 0


def test_vectors_without_distances_are_no_neighbours(spark):
    nan = float("nan")
    rows = [(0, (1, 0)), (1, (nan, 1)), (2, (1, nan)), (3, None), (4, (1, 2, 3)), (5, (float("inf"), 0)), (6, ()), (7, (0, 0))]
    vectors = vector_frame(spark, rows, "doc_id")
    queries = vector_frame(spark, [(0, (1, 0.5)), (1, (nan, 0)), (2, None)], "q_id")
    for search_fn in (dense.dense_topk, dense.dense_topk_lsh):
        for metric, ids in (("l2", [0, 7]), ("cosine", [0])):
            assert [(r.q_id, r.doc_id) for r in search_fn(queries, vectors, 2, metric=metric).orderBy("rank").collect()] == [(0, i) for i in ids]


def test_replaced_documents_get_their_own_index(spark, tmp_path):
    from gleaner.plans import retrieval

    def put(doc_text):
        spark.createDataFrame([(1, doc_text)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return {r.term for r in retrieval.written_index(spark, str(tmp_path)).terms.collect()}

    assert put("old words") == {"old", "words"}
    assert put("new text") == {"new", "text"}


def test_scan_documents(spark, tmp_path):
    (tmp_path / "b.md").write_text("two\nlines\n")
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "blank.md").write_text(" \n\t")
    rows = scan_documents(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [tuple(r) for r in rows] == [("a.md", "one"), ("b.md", "two\nlines\n")]


def test_failed_build_keeps_the_old_index(spark):
    path = new_folder(spark, "index")
    docs = corpus(spark, *SCHEMA_TEXTS)
    assert index.build_index(docs, path) == 4
    try:
        index.build_index(docs.where("false"), path)
        raise AssertionError("an empty corpus must be refused")
    except RuntimeError:
        pass
    assert index.read_index(spark, path).docs.count() == 4


def test_words_are_counted_on_the_documents_row(spark):
    rows = [(1, "a", "b a b"), (2, "x", ""), (3, None, "Z z"), (4, "t", None)]
    schema = "doc_id long, file_name string, text string"
    counted = index.counted_words(spark.createDataFrame(rows, schema))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.dl, r.term, r.tf, r.opens and r.opens.file_name) for r in counted.collect() if r.term) == [
        (1, 3, "a", 1, None), (1, 3, "b", 2, "a"), (3, 2, "z", 2, None)
    ]
    assert sorted((r.doc_id, r.dl, r.tf) for r in counted.collect() if not r.term)[0] == (2, 0, 0)
    # Repeated ids: counts of documents of one length add up, as rows of one document.
    again = index.counted_words(spark.createDataFrame([*rows, (1, "a", "a a c"), (1, "b", "d")], schema)).where("doc_id = 1")
    assert sorted((r.dl, r.term, r.tf) for r in again.collect()) == [(1, "d", 1), (3, "a", 3), (3, "b", 2), (3, "c", 1)]


def test_norms_move_counts_to_documents_once(spark):
    idx = index.plan_index(corpus(spark, "a b c", "a b b", "a"))
    plan = idx.postings._jdf.queryExecution().optimizedPlan().toString()
    # One join, with the words; the norm is a sum over a document's own rows.
    assert plan.count("Join") == 1
    found = {(r.doc_id, r.term): r.tf / r.norm for r in idx.postings.collect()}
    weights = {(r.doc_id, r.term): r.weight for r in index.tfidf_vectors(corpus(spark, "a b c", "a b b", "a")).collect()}
    assert set(found) == set(weights) and max(f for (d, t), f in found.items() if t == "a") > 0


def test_written_postings_move_once_and_have_the_norms_of_the_plan(spark, folder, monkeypatch):
    docs = named_documents(Tables(spark, folder).documents)
    counts = write_table(index.counted_words(docs).where("term is not null"), "counted")
    # Most words too rare for the broadcast, and several parts of the documents.
    monkeypatch.setattr(index, "BROADCAST_ROWS", 60)
    norms = index._norms(counts, index.doc_frequencies(counts), docs.count())
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in index._normed(counts.select("doc_id", "term", "tf", "dl"), norms, 200, 16)]
    assert len(plans) == 4 and not any("hashpartitioning(doc_id" in p.split("BroadcastExchange")[0] for p in plans)
    planned = {(r.doc_id, r.term): r for r in index.plan_index(docs).postings.collect()}
    for rows in (60, 1, 500_000):
        monkeypatch.setattr(index, "BROADCAST_ROWS", rows)
        some = docs if rows > 1 else docs.where("doc_id < 4")
        path = new_folder(spark, "index")
        index.build_index(some, path)
        built = index.read_index(spark, path).postings.collect()
        if rows > 1:
            assert len(built) == len(planned)
            for row in built:
                other = planned[row.doc_id, row.term]
                assert (row.bucket, row.tf, row.dl) == (other.bucket, other.tf, other.dl) and abs(row.norm - other.norm) < 1e-9
        else:
            assert len(built) == index.counted_words(some).where("term is not null").count()


def test_what_blocks_give_does_not_grow_with_them(spark, folder, monkeypatch):
    """Postings are packed once for all parts of the questions, and a task gives the best of all its blocks."""
    t = Tables(spark, folder)
    path = new_folder(spark, "index")
    index.build_index(named_documents(t.documents), path)
    idx, questions = index.read_index(spark, path), benchmark_questions(t.benchmark)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(search, "PART_WORDS", 400)
    moved, real = [], search.write_table
    monkeypatch.setattr(search, "write_table", lambda rows, name: moved.append(name) or real(rows, name))
    given, scores = [], search._scores_in_blocks
    monkeypatch.setattr(search, "_scores_in_blocks", lambda *a: given.append(real(scores(*a), "given")) or given[-1])
    for topk in (search.bm25_topk, search.tfidf_topk):
        assert sorted(map(str, topk(questions, idx, 3).collect())) == sorted(map(str, topk(questions, idx, 3, pair_budget=0).collect()))
    assert moved.count("posting-blocks") == 2
    assert len(given) == 2 and all(rows.count() <= 3 * questions.count() for rows in given)


def test_repeated_ids_add_up_beyond_the_known_impact():
    """Word 2 may be set aside for documents of one row each; the second block's document has three rows of it."""
    asked = search._Asked(pd.DataFrame({"q_id": [1, 1], "number": [1, 2], "weight": [1.0, 1.0], "max_impact": [5.0, 2.0]}))
    best = search._Best(asked, 1)
    for docs, numbers, impacts in (([10, 10], [1, 2], [5.0, 0.5]), ([20, 20, 20], [2, 2, 2], [2.0, 2.0, 2.0])):
        met = pa.table({"block": pa.array([0] * len(docs), pa.int32()), "doc_id": docs, "number": numbers, "impact": impacts})
        packed = search._pack(met)
        best.add({name: packed[name].combine_chunks()[0].as_buffer() for name in packed.column_names[1:]})
    assert best.found[0][0].tolist() == [20] and best.found[0][1].tolist() == [6.0]
