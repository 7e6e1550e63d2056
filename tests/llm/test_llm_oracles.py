"""Operators of the training-data pipeline against DuckDB."""

import pytest

from compare import connect, differences
from spinelens.llm.oracles import ORACLES
from spinelens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None
