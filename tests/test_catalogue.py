"""Every registered blob-store query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from slabwise.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def cell(x):
        return round(x, 9) if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(map(cell, r)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert normal(map(tuple, got.select(*cols).collect())) == normal(want)
