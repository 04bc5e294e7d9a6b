"""The registered training-data queries against their DuckDB statements, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from gleaner.llm import decontam, simhash
from gleaner.llm.queries import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, folder, duck, name):
    assert differences(QUERIES[name](spark, folder), duck, ORACLES[name]) == []


def test_all_are_registered():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in QUERIES and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_pipeline_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        seen.append(docs.count())
        if name != "source mixing":
            assert docs.columns == before.columns
        if name == "simhash near-dedup":
            found = simhash.op1_simhash(docs)
            assert found.where("doc_id <> component_id").isEmpty() and docs.count() == simhash.op1_simhash(before).select("component_id").distinct().count()
        if name == "benchmark decontamination":
            bench = spark.read.parquet(f"{folder}/benchmark.parquet")
            assert decontam.op7_decontamination(docs, bench).where("contaminated").isEmpty()
    assert seen[0] > seen[1] == seen[2] > seen[3] > seen[4] >= seen[5] > 0
    totals = docs.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in totals)
