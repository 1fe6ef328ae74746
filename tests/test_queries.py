"""Every registered query against its SQL twin on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle import duck, rows

from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    want = duck(small, catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_all_queries_have_sql_or_are_listed():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"generate_stub"}


def test_generate_stub_is_deterministic(spark, small):
    f = catalogue.QUERIES["generate_stub"]
    assert rows(f(spark, small).toPandas()) == rows(f(spark, small).toPandas())
