"""The text queries beside their SQL oracles, on the smallest test data."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

from lumenlake.llm import queries

_spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parents[2] / "tools" / "compare.py")
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    try:
        df = queries.QUERIES[name](spark, sf)
    except ValueError as e:
        assert "fewer than two languages" in str(e)  # too few labels in the smallest tables
        return
    columns = sorted(df.columns)
    got = sorted(tuple(compare.norm(r[c]) for c in columns) for r in df.collect())
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cur = con.execute(queries.ORACLE[name])
        have = [x[0] for x in cur.description]
        assert sorted(have) == columns and got == sorted(tuple(compare.norm(r[have.index(c)]) for c in columns) for r in cur.fetchall())
