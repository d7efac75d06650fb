"""Every query of the catalog against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from mutascale.catalog.oracle import oracle
from mutascale.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracle()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(result) > 0
    assert difference(result, duck.execute(ORACLES[name]).fetchdf()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "sample"
