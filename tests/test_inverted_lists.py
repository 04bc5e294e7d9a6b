"""Inverted lists against the exact search: recall, odd vectors, and which files are read."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators import dense, inverted_lists
from gleaner.session import new_folder
from gleaner.sources.tables import Tables, vector_corpus
from tests.test_retrieval import vector_frame


def built(spark, vectors, **options):
    path = new_folder(spark, "inverted")
    inverted_lists.build_lists(vectors, path, **options)
    return inverted_lists.read_lists(spark, path)


def every_twentieth(vectors):
    return vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), "vector")


@pytest.mark.parametrize("metric", dense.METRICS)
def test_recall_on_given_vectors(spark, folder, metric):
    vectors = vector_corpus(Tables(spark, folder).embeddings)
    asked = every_twentieth(vectors)
    near = inverted_lists.search_lists(asked, built(spark, vectors, metric=metric), 10)
    assert dense.recall(near, dense.dense_topk(asked, vectors, 10, metric=metric)).first().recall >= 0.9


def test_recall_and_work_on_gaussian_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = vector_frame(spark, enumerate(rng.normal(3.0, 1.0, (4000, 32))), "doc_id")
    asked = every_twentieth(vectors)
    index = built(spark, vectors)
    near, exact = inverted_lists.search_lists(asked, index, 10), dense.dense_topk(asked, vectors, 10)
    assert dense.recall(near, exact).first().recall >= 0.9
    reads = inverted_lists.probed(np.stack(asked.toPandas()["vector"].to_numpy()), index, 10, None)
    assert (reads @ index.n_rows).sum() < 0.8 * 200 * 4000
    # All lists probed is the exact search.
    whole = inverted_lists.search_lists(asked, index, 10, probes=len(index.n_rows))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_clustered_vectors_are_read_in_part(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 16)) * 20
    vectors = vector_frame(spark, ((i, middles[i % 40] + rng.normal(size=16)) for i in range(2000)), "doc_id")
    index = built(spark, vectors)
    one = vectors.where("doc_id = 40").select(F.col("doc_id").alias("q_id"), "vector")
    near = inverted_lists.search_lists(one, index, 5)
    assert [r.doc_id for r in near.orderBy("rank").collect()] == [r.doc_id for r in dense.dense_topk(one, vectors, 5).orderBy("rank").collect()]
    assert index.probes <= 8
    # Only the files of probed lists are scanned.
    scan = inverted_lists._search_block(index, one.toPandas(), 5, None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in scan


def test_lists_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(9)
    vectors = vector_frame(spark, [(i, rng.normal(size=8)) for i in range(300)] + [(300 + i, np.ones(8)) for i in range(150)], "doc_id")
    one, other = built(spark, vectors.coalesce(1)), built(spark, vectors.repartition(7))
    assert (one.centroids == other.centroids).all() and one.probes == other.probes
    pairs = [{(r.list, r.doc_id) for r in i.lists.select("list", "doc_id").collect()} for i in (one, other)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 450


def test_fit_with_tasks_without_rows(spark):
    vectors = vector_frame(spark, [(i, (i, i % 3)) for i in range(40)], "doc_id")
    few = vectors.repartition(7, "doc_id").where("doc_id < 3")
    assert 0 in few.rdd.glom().map(len).collect()
    fits = [inverted_lists._fit(rows, 2, "l2", 16.0) for rows in (few, few.coalesce(1))]
    assert (fits[0] == fits[1]).all()


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, (1, 0)), (1, (nan, 1)), (3, None), (4, (1, 2, 3)), (5, (float("inf"), 0)), (6, ()), (7, (0, 0)), (8, (1, 0)), (None, (2, 2)), (0, (1, 0))]
    vectors = vector_frame(spark, rows, "doc_id")
    asked = vector_frame(spark, [(0, (1, 0.5)), (1, (nan, 0)), (2, None), (3, (1, 2, 3))], "q_id")
    for metric, ids in (("l2", [0, 0, 8, 7, None]), ("cosine", [None, 0, 0, 8])):
        found = inverted_lists.search_lists(asked, built(spark, vectors, metric=metric), 9).orderBy("rank").collect()
        assert {r.q_id for r in found} == {0} and sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, ids))
    assert inverted_lists.search_lists(asked.where("false"), built(spark, vectors), 5).count() == 0
    with pytest.raises(RuntimeError):
        inverted_lists.build_lists(vectors.where("false"), new_folder(spark, "inverted"))
    with pytest.raises(ValueError):
        inverted_lists.build_lists(vectors, new_folder(spark, "inverted"), metric="other")


def test_tasks_of_a_search_load_without_the_package(spark, monkeypatch):
    vectors = vector_frame(spark, [(i, (i, 1.0)) for i in range(40)], "doc_id")
    index, seen, real = built(spark, vectors), [], type(vectors).mapInPandas
    monkeypatch.setattr(type(vectors), "mapInPandas", lambda self, f, schema: seen.append(f) or real(self, f, schema))
    inverted_lists.search_lists(every_twentieth(vectors), index, 3)
    load = "import sys, pyspark.core.broadcast as b; from pyspark import cloudpickle; b._from_id = lambda i: None; cloudpickle.loads(sys.stdin.buffer.read())"
    for function in seen:
        done = subprocess.run([sys.executable, "-I", "-c", load], input=cloudpickle.dumps(function), capture_output=True)
        assert done.returncode == 0, done.stderr.decode()[-500:]
    assert seen
