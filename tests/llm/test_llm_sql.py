"""Queries that SQL expresses, against DuckDB."""

import pytest
from compare import assert_same, duck

from declarium.llm.queries import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(sf, query, name):
    assert_same(query(name), duck(sf).execute(ORACLES[name]).fetchdf())
