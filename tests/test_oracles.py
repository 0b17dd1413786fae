"""Every plan with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from symatlas.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small, duck, name):
    frame = registry.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == columns
    assert got == sorted((tuple(norm(row[i]) for i in order) for row in result.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
