"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lattix.jobs.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    return str(round(float(v), 6) + 0.0) if isinstance(v, int | float | np.integer | np.floating) else str(v)


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].map(plain).values))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert rows(got) == rows(duck.execute(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark).toPandas()
    assert got["final_rank"].tolist() == sorted(got["final_rank"]) or sorted(got["final_rank"]) == list(range(1, len(got) + 1))
