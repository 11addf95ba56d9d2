"""Every registered query that has SQL gives the same rows as DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from mnemolake import plans  # noqa: F401  (fills the registry)
from mnemolake.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    cols = sorted(df.columns)
    return [tuple(cols), *sorted(tuple(map(one, r)) for r in df[cols].astype(object).itertuples(index=False))]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert plain(got) == plain(duck.execute(SQL[name]).df())
