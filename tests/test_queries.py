"""Every registered query of the signal operators runs, and equals its SQL where it has some."""

import pytest

from eventloom import catalog

from conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(spark, sf, duck, name):
    same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
