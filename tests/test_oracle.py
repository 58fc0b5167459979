"""Every registered query against its DuckDB SQL (the driver's correctness gate), at sf0.001."""

import pytest

import __spark_entry__ as entry
from tabrecon.plans.registry import QUERIES
from tests.compare import compare, duck
from tests.conftest import SF_SMALL

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(entry.queries()[name](spark, SF_SMALL), entry.oracle_sql()[name], con)
    assert r["schema"], (r["cols"], r["oracle_cols"])
    assert r["rows"] == r["oracle_rows"]
    assert r["values"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "o_totalprice", "o_custkey"]
    assert df.count() > 0
