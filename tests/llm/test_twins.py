"""The operators' queries against their SQL twins at the smallest scale."""

import pytest

from compare import connect, difference
from mutascale.llm.oracle import ORACLE
from mutascale.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(result) > 0
    assert difference(result, duck.execute(ORACLE[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
