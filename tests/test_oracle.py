"""Every registered query against its DuckDB oracle on the smallest data."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from habitlake.plans import registry
from tools.compare import compare, duck_con

NAMES = sorted(registry.builders())


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["cols_ok"], r
    assert "types" not in r, r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values_ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "productivity_points", "best_productivity_day", "productivity_days", "time"]


def test_every_query_has_an_oracle_and_is_registered():
    assert set(registry.builders()) == set(registry.oracles())
    assert set(registry.builders()) <= set(E.queries()) and set(registry.oracles()) <= set(E.oracle_sql())
