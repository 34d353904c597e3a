"""Queries with SQL give the same rows as DuckDB; the others run over the whole table."""

import pytest

from hazegrid.llm import registry
from tests.harness import compare, duck

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    ok, msg = compare(QUERIES[name](spark, DIR), ORACLES[name], duck(DIR))
    assert ok, msg


@pytest.mark.parametrize("name", ["op7_language_id", "op8_toxicity", "op2_simhash_near_dedup", "op5_token_ids"])
def test_one_row_per_document(spark, name):
    r = QUERIES[name](spark, DIR)
    assert sorted(x[0] for x in r.select("doc_id").collect()) == sorted(
        x[0] for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect())
