"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest
from quillon.plans.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if x != x else round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, db, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(db.execute(SQL[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["item_id", "doc_id", "rnk", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
