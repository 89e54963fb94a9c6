"""Every query with an oracle against DuckDB on the smallest tables, and the contract."""

import pytest

import __spark_entry__ as contract
from checks.catalog import ENTRIES
from checks.compare import difference, oracle_connection


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_matches_oracle(spark, small, con, name):
    got = ENTRIES[name].run(spark, small).toPandas()
    assert difference(got, con.execute(ENTRIES[name].sql).df()) is None


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) < set(contract.queries())
