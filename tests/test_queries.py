"""Every registered query of the segment engine at the smallest scale, against its SQL."""

import duckdb
import pytest

from framewright.plans import every
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(every.QUERIES))
def test_query(spark, duck, name):
    df = every.QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in every.SQL:
        want = duck.sql(every.SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == canonical(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
