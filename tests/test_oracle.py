"""Every query of the engine that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest
from compare import differences, duck

from corvane.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, tiny, con, name):
    found = catalogue.queries()[name](spark, tiny).toArrow()
    assert differences(found, con.sql(SQL[name]).to_arrow_table()) == []
