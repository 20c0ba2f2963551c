"""Every general query against its SQL, at sf0.01."""

import pytest

from quadrille.plans import problems, workload
from tests import compare

ALL = {**problems.QUERIES, **workload.QUERIES}
SQL = {**problems.ORACLE_SQL, **workload.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    compare.check(spark, sf, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, sf, name):
    assert ALL[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 121
