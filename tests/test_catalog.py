"""Every registered query of the vocabulary engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from glossweave import catalog, catalog_handbooks, catalog_readers, catalog_rules  # noqa: F401  (register their queries)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    return round(float(v), 4) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    expect = [dict(zip(names, r)) for r in cur.fetchall()]
    key = lambda r: str(sorted((k, str(plain(v))) for k, v in r.items()))
    got = sorted((key(r.asDict()) for r in rows))
    want = sorted(map(key, expect))
    assert len(got) == len(want)
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)
