"""Every query of the catalog on the smallest tables, against its SQL in DuckDB."""

import duckdb
import pytest

from treegrain.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in catalog.ORACLE_SQL:
        result = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(result.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(result.columns, result.fetchall())


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push(spark, small):
    plan = catalog.QUERIES["expand_conversations"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema", 1)[1].split(">")[0]
    assert "CartesianProduct" not in plan
