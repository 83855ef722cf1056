"""Every text query, and the pipeline, beside its SQL on the smallest data."""

import os

import pytest

import corpus_pipeline
from quantgap.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    problem, _ = compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem


def test_pipeline(spark):
    problem, _ = compare(spark, connect(FOLDER), "pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL, FOLDER)
    assert problem is None, problem


def test_stages_on_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, taken string, _tokens int"
    odd = spark.createDataFrame([(1, None, None, None, None, "x", 1), (1, None, None, None, None, "x", 1), (None, "", "en", "s", 0, None, None)], schema)
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            got = stage(spark, table, str(tmp_path))
            assert got.columns[: len(odd.columns)] == odd.columns
            got.collect()
