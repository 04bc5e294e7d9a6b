"""Singular vectors of the tf-idf matrix against numpy's, and the searches over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dense, index, latent
from gleaner.plans import retrieval
from gleaner.session import new_folder
from gleaner.sources.tables import Tables, named_documents

DOCS = "doc_id long, file_name string, text string"


def indexed(spark, docs):
    path = new_folder(spark, "index")
    index.build_index(docs, path)
    return index.read_index(spark, path)


def built(spark, idx, **options):
    path = new_folder(spark, "latent")
    values = latent.build_latent(idx, path, **options)
    return values, latent.read_latent(spark, path)


def matrix(docs):
    rows = index.tfidf_vectors(docs).toPandas()
    ids, terms = sorted(rows["doc_id"].unique()), sorted(rows["term"].unique())
    out = np.zeros((len(ids), len(terms)))
    out[rows["doc_id"].map({d: i for i, d in enumerate(ids)}), rows["term"].map({t: i for i, t in enumerate(terms)})] = rows["weight"]
    return ids, terms, out


def stacked(rows, key, order):
    found = {r[key]: r.vector for r in rows.collect()}
    return np.array([found[k] for k in order])


def test_same_subspace_as_numpy(spark, folder):
    docs = named_documents(Tables(spark, folder).documents)
    ids, terms, a = matrix(docs)
    # Several blocks, so sums over blocks are tested too.
    values, got = built(spark, indexed(spark, docs), dims=8, block_entries=3000)
    exact, right = np.linalg.svd(a, full_matrices=False)[1:]
    # Four directions stand out (one a language); the next ones are nearly as long as one another.
    assert np.allclose(values[:4], exact[:4], rtol=1e-4) and np.allclose(values, exact[:8], rtol=0.04)
    v = stacked(got.words, "term", terms)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-8)
    # The part of A that the space misses is hardly more than the least possible.
    assert np.linalg.norm(a - a @ v @ v.T) <= 1.005 * np.sqrt((exact[8:] ** 2).sum())
    # The best separated directions are the same.
    angles = np.linalg.svd(v.T @ right[:4].T)[1]
    assert angles.min() > 0.99
    assert np.allclose(stacked(got.docs, "doc_id", ids), a @ v, atol=1e-8)


def test_low_rank_odd_documents_and_questions(spark):
    rows = [(1, "a", "cat dog"), (2, "b", "cat dog"), (3, "c", "bird"), (4, "d", "..."), (5, "e", ""), (None, "f", "cat"), (6, "g", "bird " * 30_000)]
    idx = indexed(spark, spark.createDataFrame(rows, DOCS))
    values, got = built(spark, idx, dims=5)
    # Two different directions only, however many are asked for.
    assert len(values) == 2
    found = {r.doc_id: np.array(r.vector) for r in got.docs.collect()}
    assert sorted(found) == [1, 2, 3, 6] and np.allclose(found[1], found[2]) and np.allclose(found[3], found[6])
    questions = spark.createDataFrame([(1, "DOG, dog"), (2, "unknown"), (3, None), (4, "")], "q_id long, question string")
    asked = latent.question_vectors(questions, idx, got)
    assert [r.q_id for r in asked.collect()] == [1]
    near = dense.dense_topk(asked, got.docs, 2, metric="cosine").orderBy("rank").collect()
    assert [(r.doc_id, r.distance) for r in near] == [(1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        latent.build_latent(idx, new_folder(spark, "latent"), dims=0)


def test_blocks_do_not_change_vectors(spark, folder):
    idx = indexed(spark, named_documents(Tables(spark, folder).documents))
    one, other = built(spark, idx, dims=4), built(spark, idx, dims=4, block_entries=1000)
    assert np.allclose(one[0], other[0])
    ids = [r.doc_id for r in one[1].docs.select("doc_id").collect()]
    assert np.allclose(stacked(one[1].docs, "doc_id", ids), stacked(other[1].docs, "doc_id", ids), atol=1e-6)


def test_only_words_of_several_blocks_move(spark, folder, monkeypatch):
    idx = indexed(spark, named_documents(Tables(spark, folder).documents))
    written, real = [], latent.write_table
    monkeypatch.setattr(latent, "write_table", lambda rows, name: written.append((name, real(rows, name))) or written[-1][1])
    _, got = built(spark, idx, dims=4, block_entries=10_000)
    held = written[0][1].select("block", F.explode("terms").alias("term")).groupBy("term").count()
    assert held.select(F.max("count")).first()[0] > 1
    several = {r.term for r in held.where("count > 1").collect()}
    tables = [rows for name, rows in written if name == "word-vectors"]
    # A pass writes the vectors of those words alone; in the end every word has one.
    assert len(tables) == latent.PASSES and all({r.term for r in rows.collect()} == several for rows in tables)
    assert len(several) < held.count() == got.words.count()


def test_full_rank_search_is_the_cosine_search(spark, folder):
    """With every direction kept, latent neighbours are the tf-idf neighbours."""
    docs = named_documents(Tables(spark, folder).documents).where("doc_id < 30")
    idx = indexed(spark, docs)
    questions = docs.select(F.col("doc_id").alias("q_id"), F.col("text").alias("question"))
    _, got = built(spark, idx, dims=30)
    near = dense.dense_topk(latent.question_vectors(questions, idx, got), got.docs, 3, metric="cosine")
    best = retrieval.search.tfidf_topk(questions, idx, 3)
    pairs = [{(r.q_id, r.doc_id) for r in rows.collect()} for rows in (near, best)]
    assert len(pairs[0] & pairs[1]) >= 0.95 * len(pairs[1])


def test_registered_queries(spark, folder):
    vectors = retrieval.latent_vectors(spark, folder).collect()
    assert len(vectors) == Tables(spark, folder).documents.count() and {r.n_dims for r in vectors} == {latent.DIMS}
    # Each document is a unit row of A, and a projection is no longer than that.
    assert all(0 < r.length <= 1 + 1e-9 for r in vectors)
    found = retrieval.latent_recall(spark, folder).first()
    assert found.n_questions == 40 and found.n_found == round(found.recall * 40)


def test_memory_of_a_block_does_not_follow_its_longest_word(spark):
    """60,000 entries as wide as this word would be 48 GB."""
    rows = [(i, "a", " ".join(f"w{(i * 1009 + j) % 7001}" for j in range(2000))) for i in range(30)]
    idx = indexed(spark, spark.createDataFrame([*rows, (30, "b", "w1 " + "x" * 200_000)], DOCS))
    values, got = built(spark, idx, dims=2, passes=1)
    assert len(values) == 2 and got.docs.count() == 31 and got.words.count() == idx.terms.count()


def test_first_signs_are_those_of_xxhash64(spark):
    words = ["a", "word", "x_1", "0" * 50]
    rows = spark.createDataFrame([(w,) for w in words], "term string")
    wanted = rows.select("term", *[F.pmod(F.xxhash64("term", F.lit(i)), F.lit(2)).alias(f"c{i}") for i in range(1, 8)]).collect()
    found = np.stack(list(latent._signs([w.encode() for w in words], 7)), axis=1)
    assert {r[0]: [2.0 * x - 1 for x in r[1:]] for r in wanted} == dict(zip(words, found.tolist()))
