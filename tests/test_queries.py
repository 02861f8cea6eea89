"""Every registered market query against its oracle, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from candela.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def _told(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    result = oracle.execute(registry.oracle_sql()[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    wanted = sorted(tuple(_told(row[k]) for k in at) for row in result.fetchall())
    assert sorted(tuple(map(_told, row)) for row in got.select(*names).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(v is None or not isinstance(v, float) or math.isfinite(v) for row in rows for v in row)
