import pytest
from oracle import duck, rows

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck(small, ORACLE_SQL[name]))


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
