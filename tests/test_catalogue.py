"""Every registered query equals its SQL at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from weirflow import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    assert columns == sorted(names) and got == want
