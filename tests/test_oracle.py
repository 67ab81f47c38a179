"""Every query of the engine against its DuckDB SQL on the small tables."""

import os

import duckdb
import pytest

from plumbline.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        name = f.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    wanted = oracle.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, got) == rows(wanted.columns, wanted.fetchall())
