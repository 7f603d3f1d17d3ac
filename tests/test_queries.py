"""Every registered query with SQL must match DuckDB on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, run_duck

from .conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    d = run_duck(SF_SMALL, SQL[name])
    assert sorted(sdf.columns) == sorted(d["cols"])
    assert len(rows) == len(d["rows"])
    assert digest(sdf.columns, rows)[0] == digest(d["cols"], d["rows"])[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "demographic_parity" in df.columns
