"""Every catalogued query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from barloom.plans.all_plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(([show(r[i]) for i in order] for r in data), key=str)


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    if name not in ORACLES:
        got.count()
        return
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
