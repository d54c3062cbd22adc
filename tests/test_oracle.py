"""Every core query against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from textloom import queries

FOLDER = os.environ.get("TEXTLOOM_SF", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(rows):
    return sorted((tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = tables.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert norm(df.select(*[f"`{c}`" for c in columns]).collect()) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_runs(spark):
    for name, f in queries.queries().items():
        if name not in SQL:
            assert f(spark, FOLDER).count() >= 0, name
