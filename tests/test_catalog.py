import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.4f}"
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    want = sorted(tuple(cell(r[order.index(c)]) for c in names) for r in cursor.fetchall())
    assert sorted(order) == names and got == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())



def test_entry(spark):
    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
