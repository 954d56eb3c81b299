"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pandas as pd
import pytest

from gridloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, data, duck, name):
    got = catalog.queries()[name](spark, data)
    rows = got.toPandas()
    if sql := catalog.oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(rows) == plain(want)
    else:
        assert len(rows.columns) > 0
