"""Every registered query against its DuckDB statement, in both directions."""

import pytest

import __spark_entry__ as entry_module
from gleaner.plans import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, folder, duck, name):
    assert differences(QUERIES[name](spark, folder), duck, ORACLES[name]) == []


# SQL has no eigenvectors; tests/test_latent.py compares these with numpy's.
WITHOUT_STATEMENT = {"latent_vectors", "latent_topk", "hybrid_retrieve_latent", "latent_recall"}


def test_every_query_has_a_statement():
    assert set(QUERIES) - WITHOUT_STATEMENT == set(ORACLES)


def test_entry_has_rows(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["q_id", "rank", "doc_id", "file_name", "score"]
    assert result.count() > 0
