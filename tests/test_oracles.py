"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from trackloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return f"{float(v) + 0.0:.4f}".replace("-0.0000", "0.0000")
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLES:
        assert rows and got.columns
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == want
