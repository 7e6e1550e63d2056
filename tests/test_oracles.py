"""Every registered query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences
from spinelens.plans.oracles import ORACLES
from spinelens.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_entry_has_rows(spark, sf_dir):
    df = contract.entry(spark)
    assert df.columns[0] == "image_id" and len(df.columns) == 13 and df.count() > 0
