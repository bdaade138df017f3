"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

from quern import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    return round(float(x), 4) + 0.0 if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    cursor = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=str)
    assert got == want


def test_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["request_filters_eq"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan
