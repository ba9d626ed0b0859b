"""Every registered query against its SQL on the smallest tables, and the rest for shape."""

import math
import os

import duckdb
import pandas as pd
import pytest

from loomfact import plans
from loomfact.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
plans.load()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "-"
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 6))
        return repr(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
