"""Every telemetry query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidegauge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in catalog.SQL:
        cur = duck.execute(catalog.SQL[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == want[0] and len(got[1]) == len(want[1])
        for a, b in zip(*(sorted(x, key=lambda r: tuple(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r)) for x in (got[1], want[1]))):
            assert all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b)), (a, b)
