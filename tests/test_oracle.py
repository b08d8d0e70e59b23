"""Every query at the smallest scale; those with SQL against DuckDB, value by value."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Whole runs have tests of their own.
SLOW = {"pl_standard", "pl_enhanced"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows, columns):
    return sorted(tuple(repr(r[c] + 0.0) if isinstance(r[c], float) else repr(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert rows or name in ()
    if name in catalog.ORACLE_SQL:
        cur = duck.execute(catalog.ORACLE_SQL[name])
        columns = sorted(x[0] for x in cur.description)
        assert columns == sorted(df.columns)
        names = [x[0] for x in cur.description]
        assert shown(rows, columns) == shown([dict(zip(names, r)) for r in cur.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
