"""Every registered query of the engine against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from karstflow.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, duck):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(cell, r)) for r in got.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall()
    assert rows == sorted(tuple(map(cell, r)) for r in want)
