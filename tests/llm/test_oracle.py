import duckdb
import pytest

from tessera.llm import registry

from .helpers import SF


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(repr(r[n]) for n in sorted(names))
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(key(dict(zip(names, r))) for r in cur.fetchall())
