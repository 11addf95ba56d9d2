"""Queries of the subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from mnemolake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), c.execute(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731  pandas gives long columns with nulls as doubles
    plain = lambda df: sorted(str([whole(x) for x in row]) for row in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())
    assert plain(a) == plain(b)
