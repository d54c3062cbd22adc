"""The queries of the llm subpackage against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from textloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


def norm(rows):
    return sorted((tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, FOLDER)
    columns, want = sorted(df.columns), con.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert norm(df.select(*[f"`{c}`" for c in columns]).collect()) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())
