"""Every registered query against its DuckDB form on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from salesignal import plans

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def tables():
    if not DATA.exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, tables, name):
    df = plans.QUERIES[name](spark, str(DATA))
    want = tables.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_all_names_have_functions():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 60
