"""Every query of the library with SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomcut import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from '{t}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.ORACLE:
        assert got
        return
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got) == sorted(tuple(map(plain, r)) for r in cur.fetchall())
