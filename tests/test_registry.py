"""Every registered query against its SQL twin in DuckDB on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from boxmill.plans.registry import QUERIES, SQL, flagship

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(df) -> list[tuple]:
    out = df[sorted(df.columns)]

    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return "null"
        try:
            return round(float(x), 5)
        except (TypeError, ValueError):
            return str(x)

    return sorted((tuple(plain(x) for x in r) for r in out.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert {r["class_id"] for r in flagship(spark, DATA).collect()} == set(range(6))
