"""Postings in blocks: the rows of the plain search, and how many blocks it reads."""

import numpy as np
import pytest

from gleaner.operators import blocks, index, search
from gleaner.session import new_folder
from gleaner.sources.tables import Tables, benchmark_questions, named_documents
from tests.test_retrieval import asked, corpus


def built(spark, docs, **options):
    path = new_folder(spark, "index")
    index.build_index(docs, path)
    idx = index.read_index(spark, path)
    blocks.build_blocks(idx, f"{path}/blocks", **options)
    return idx, blocks.read_blocks(spark, f"{path}/blocks", idx)


def rows(found):
    return sorted((r.q_id, r.rank, r.doc_id, r.score) for r in found.collect())


@pytest.mark.parametrize("first_docs", [None, 30])
def test_same_rows_as_the_plain_search(spark, folder, first_docs):
    t = Tables(spark, folder)
    questions, docs = benchmark_questions(t.benchmark), named_documents(t.documents)
    idx, packed = built(spark, docs, block_docs=8)
    assert rows(blocks.bm25_topk_blocks(questions, packed, 5, first_docs=first_docs)) == rows(search.bm25_topk(questions, idx, 5))


def test_blocks_of_common_words_are_skipped(spark):
    rng = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(3000)]
    texts = [" ".join([*rng.choice(common, 25), *rng.choice(rare, 6)]) for _ in range(3000)]
    idx, packed = built(spark, corpus(spark, *texts), block_docs=16)
    questions = asked(spark, *[" ".join([*rng.choice(rare, 4), *rng.choice(common, 6)]) for _ in range(20)])
    assert rows(blocks.bm25_topk_blocks(questions, packed, 5, first_docs=40)) == rows(search.bm25_topk(questions, idx, 5))
    reads = {r.is_common: r for r in blocks.block_reads(questions, packed, 5, first_docs=40).collect()}
    assert 0 < reads[True].n_read < reads[True].n_blocks


def test_a_block_read_is_one_row_for_all_questions(spark, monkeypatch):
    rng = np.random.default_rng(6)
    idx, packed = built(spark, corpus(spark, *[" ".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]), block_docs=8)
    questions, real, written = asked(spark, *[" ".join(rng.choice(list("abcdefghij"), 8)) for _ in range(30)]), blocks.write_table, {}

    def write(rows, name):
        written[name] = real(rows, name)
        return written[name]

    monkeypatch.setattr(blocks, "write_table", write)
    monkeypatch.setattr(blocks, "BLOCK_POSTINGS", 500)
    found = rows(blocks.bm25_topk_blocks(questions, packed, 5, first_docs=20))
    assert found == rows(search.bm25_topk(questions, idx, 5))
    assert 0 < written["reads"].count() <= packed.n_blocks
    # Postings of many groups of blocks, too.
    small = built(spark, idx.docs.select("doc_id", "file_name").join(corpus(spark, *["a b c"] * 200).select("doc_id", "text"), "doc_id"), block_docs=8)[1]
    assert small.packed.groupBy("bucket", "term", "block").count().where("count > 1").isEmpty()


def test_named_questions_and_documents(spark):
    docs = spark.createDataFrame([("x", "f", "a b"), ("y", "f", "a c"), ("z", "f", "d e f")], "doc_id string, file_name string, text string")
    idx, packed = built(spark, docs, block_docs=1)
    questions = spark.createDataFrame([("p", "d e"), ("q", "c f"), (None, "b")], "q_id string, question string")
    for first_docs in (None, 1):
        found = blocks.bm25_topk_blocks(questions, packed, 3, first_docs=first_docs)
        order = lambda r: tuple(map(str, r))
        expected = search.bm25_topk(questions, idx, 3).select(found.columns)
        assert sorted(map(tuple, found.collect()), key=order) == sorted(map(tuple, expected.collect()), key=order)


def test_odd_questions_and_negative_weights(spark):
    # Words in most documents only: weights are a share of a negative mean, nothing is set aside.
    texts = ["a b", "a b", "a b c", "a", "b", ""]
    idx, packed = built(spark, corpus(spark, *texts), block_docs=2)
    for questions in (asked(spark, "a b", "?!", "", "a a zzz c", "unknown"), asked(spark, "a").where("false")):
        assert rows(blocks.bm25_topk_blocks(questions, packed, 3)) == rows(search.bm25_topk(questions, idx, 3))
        assert rows(blocks.bm25_topk_blocks(questions, packed, 3, first_docs=1)) == rows(search.bm25_topk(questions, idx, 3))
