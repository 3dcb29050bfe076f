import pytest

from kinfold.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    if name not in catalog.ORACLE_SQL:
        assert catalog.QUERIES[name](spark, SF).count() > 0
        return
    ours, theirs = oracle.compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
