"""Every registered query runs; those with SQL give the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tidemark import plans

SMALL = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SMALL)
    rows = df.collect()
    if name in SQL:
        got = con.execute(SQL[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(df.columns)
        want = plain(got.fetchall(), columns)
        have = plain(rows, df.columns)
        assert len(want) == len(have)
        for a, b in zip(have, want, strict=True):
            assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-5)) for x, y in zip(a, b, strict=True))


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
