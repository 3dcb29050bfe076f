import pytest

from kinfold.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = oracle.compare(spark, oracle.connect(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert ours == theirs


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
