"""Every registered query against its SQL, on the small data set."""

import pytest

import __spark_entry__ as entry
from tidemark.plans import queries as plans
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"
ORACLES = {n: q for n, q in entry.oracle_sql().items() if n in plans.registered()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_its_sql():
    assert set(plans.registered()) == set(ORACLES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "device_id" and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLES[name]) == []
