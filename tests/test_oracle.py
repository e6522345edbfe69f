"""Every registered query of the reference's operators against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from marlstone.plans.oracle import ORACLE_SQL
from marlstone.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = f"{path}/*" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(rows):
    return sorted((tuple(str(v) for v in r) for r in rows))


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)
