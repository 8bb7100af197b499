"""Every query of the engine against its SQL, on the smallest tables; the scalar cases state their results in SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from leafquarry.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x if x is None else str(x)


HEAVY: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    if name not in ORACLE:
        return
    wanted = duck.sql(ORACLE[name])
    assert sorted(wanted.columns) == columns
    places = [wanted.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[p]) for p in places]) for r in wanted.fetchall())
