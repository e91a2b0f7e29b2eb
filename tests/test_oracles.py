"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {n: q for n, q in entry.queries().items() if n in entry.oracle_sql() and not n.startswith("op")}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def text(v):
    if v is None or v != v:
        return None
    return f"{v + 0.0:.4f}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(str(text(dict(zip(columns, r))[c])) for c in order) for r in got.fetchall())
    have = sorted(tuple(str(text(r[c])) for c in order) for r in df.collect())
    assert have == want
