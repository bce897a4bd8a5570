"""Every registered query with SQL against DuckDB, and the rest for rows."""

import pytest

from linkloom.plans import catalog, check


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    said = check.compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf)
    if said == "no rows":  # too small a table for this query
        larger = sf.replace("0.001", "0.01")
        said = check.compare(spark, check.connect(larger), catalog.QUERIES[name], catalog.ORACLE_SQL[name], larger)
    assert said == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
