"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import pytest

from tracewell import queries as Q

DATA = "/root/testdata/sf0.01"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_matches_duckdb(spark, con, name):
    got = Q.QUERIES[name](spark, DATA)
    want = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    have, need = rows([tuple(r) for r in got.collect()], got.columns), rows(want.fetchall(), names)
    assert len(need) > 0
    assert have == need


def test_flagship_and_shipped_patterns(spark):
    assert Q.flagship(spark, "/root/testdata/sf0.001").count() > 0
    assert Q.QUERIES["shipped_patterns"](spark, DATA).columns == ["rule", "severity", "title", "us", "key"]
