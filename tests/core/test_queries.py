"""Registered queries against DuckDB over the same tables."""

import duckdb
import pytest

from lodestar import queries

TABLES = "embeddings documents pages".split()


def plain(rows, columns):
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.Q[name](spark, sf_dir)
    got = con.execute(queries.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain((r.asDict() for r in df.collect()), sorted(names)) == plain((dict(zip(names, r)) for r in got.fetchall()), sorted(names))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
