"""Every registered query of the archive and the tables against its SQL."""

import pytest
from helpers import SF, rows_of, rows_of_sql

from stumpline.plans.catalog import QUERIES, oracle_sql

ORACLES = oracle_sql()


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
