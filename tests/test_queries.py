"""Every query against its SQL; those without SQL must give rows of a stable schema."""

from __future__ import annotations

import oracle
import pytest

from pairloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.differences(QUERIES[name], SQL[name], spark) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    a, b = (QUERIES[name](spark, oracle.DATA) for _ in range(2))
    assert a.schema == b.schema
    assert a.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
