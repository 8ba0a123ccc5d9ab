"""Every registered query against its DuckDB oracle on the smallest data set.

Fitted-model queries (no oracle) are exercised by the driver's run and by
`tests/oracle_check.py`; here they are skipped to keep the suite quick.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import check, duck

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 90


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = check(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["lat_bin", "n", "n_hit", "ndvi", "off", "ta"]
    assert df.count() > 0
