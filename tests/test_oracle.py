"""Every registered query equals its SQL twin on the whole test tables."""

import pytest
from comparing import mismatch

import __spark_entry__ as entry_module
from quayside.plans.oracle import oracle_sql
from quayside.plans.registry import queries

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, small, name):
    assert mismatch(queries()[name](spark, small), duck, SQL[name]) is None


def test_entry_is_the_flagship(spark, duck):
    assert mismatch(entry_module.entry(spark), duck, SQL["agg_ship_mode_performance"]) is None


def test_every_query_has_sql():
    assert set(SQL) == set(queries())
    assert set(queries()) <= set(entry_module.queries())
