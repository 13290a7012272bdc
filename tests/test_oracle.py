"""Every registered query against its SQL oracle at the smallest scale."""

import math
import os

import duckdb
import pytest

from commentlens.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        return repr(round(value, 5)) if isinstance(value, float) else str(value)

    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    got = canonical(result.columns, result.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cursor = duck.execute(ORACLES[name])
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want
