"""Every registered query with SQL against DuckDB, and the others against independent models."""

import math

import duckdb
import pytest

from netloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple((x is None, round(x, 3) if isinstance(x, float) else x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    want = con.sql(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    a, b = sorted(map(tuple, got.select(*names).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
