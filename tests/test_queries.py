"""Every core query that has SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def canon(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return tuple(map(canon, v))


def connection():
    c = duckdb.connect()
    for path in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def core():
    from folioforge import plans

    return [(m, n) for m in plans.MODULES for n in __import__(f"folioforge.plans.{m}", fromlist=["QUERIES"]).QUERIES]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("module,name", core())
def test_query(spark, module, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(canon, r)) for r in df.select(*columns).collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = connection().execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(canon(r[i]) for i in order) for r in result.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["table_name", "row_key", "reason", "period"]


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/folioforge/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "folioforge.llm" not in open(path, encoding="utf-8").read(), path
