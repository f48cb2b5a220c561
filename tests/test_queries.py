"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from corpusloom.plans import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return float(f"{float(v):.6g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    df = registry.queries()[name](spark, str(DATA))
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in row]) for row in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want
