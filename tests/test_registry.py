"""Every registered query runs on the smoke tables and agrees with its DuckDB oracle."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"instance", "cpu", "memory", "status"}


def test_oracles_belong_to_queries():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_oracle(spark, con, key):
    df = queries()[key](spark, SF)
    a = _rows([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(oracle_sql()[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert a == _rows(res.fetchall(), cols)
