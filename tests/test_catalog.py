"""Every core query with an oracle gives the oracle's rows on the smallest test data; names and contracts hold."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumenlake.plans import catalog

_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parent.parent / "tools" / "compare.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(compare.norm(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLE:
        cur = con.execute(catalog.ORACLE[name])
        have = [x[0] for x in cur.description]
        assert sorted(have) == columns
        assert got == sorted(tuple(compare.norm(r[have.index(c)]) for c in columns) for r in cur.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
