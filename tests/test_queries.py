"""Every query runs, and gives what its SQL gives in DuckDB."""

import math

import duckdb
import pytest

from resolva.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]

    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NULL"
        return round(x + 0.0, 5) if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in row) for row in df.astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, con, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    if name in catalogue.oracle_sql():
        want = con.sql(catalogue.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got.columns) > 1
