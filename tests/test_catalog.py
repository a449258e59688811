"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from tidegrid import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "embeddings", "customer", "supplier")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    mine = catalog.queries()[name](spark, SF).toPandas()
    assert len(mine)
    sql = catalog.oracle_sql().get(name)
    if sql:
        theirs = duck.execute(sql).df()
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns)
        assert rows(mine, columns) == rows(theirs, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
