import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries as core


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    rows = duck.execute(core.ORACLE[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    assert got == Counter(tuple(_plain(r[i]) for i in at) for r in rows.fetchall())


def test_flagship(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1)) and rows


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
