"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lodestar.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, float):
            return f"{v + 0.0:.6f}" if not math.isinf(v) else str(v)
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(mine)
        return
    theirs = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    for c in mine.columns:
        if mine[c].dtype.kind == "f" or theirs[c].dtype.kind == "f":
            mine[c], theirs[c] = mine[c].astype(float), theirs[c].astype(float)
    assert rows(mine) == rows(theirs)
