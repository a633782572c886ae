"""Each query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from kelpline.plans import registry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry()
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(frame, columns):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, str(FOLDER)).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0
