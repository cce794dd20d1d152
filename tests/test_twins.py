"""Every query with a SQL twin gives the same columns, types and values in DuckDB."""

import pytest
import twins

from textreg.queries.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return twins.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, folder, con, name):
    assert twins.differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
