"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from navgrid.queries import REGISTRY
from oracle import connect, differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables are not here")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert operator not in plan
    if name in ORACLES:
        assert [d for d in differences(df, duck, ORACLES[name]) if d != "(empty)"] == []
    else:
        df.count()
    spark.catalog.clearCache()


def test_flagship(spark):
    assert entry.entry(spark).count() == 6


def test_every_query_of_the_library_has_sql():
    assert set(REGISTRY) <= set(entry.queries()) and set(REGISTRY) <= set(ORACLES)
