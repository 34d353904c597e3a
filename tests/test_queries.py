"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import os

import pytest

from hazegrid.plans import load
from tests.harness import compare, duck

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REG = load()


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(REG.ORACLES))
def test_oracle(spark, con, name):
    ok, msg = compare(REG.QUERIES[name](spark, DIR), REG.ORACLES[name], con)
    assert ok, msg


# fitted models need more rows than the smallest data have
@pytest.mark.parametrize("name", sorted(set(REG.QUERIES) - set(REG.ORACLES)))
def test_runs(spark, name):
    assert REG.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
