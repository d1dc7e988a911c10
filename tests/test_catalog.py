"""Every query against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from graphloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"shortest_path_unreachable"}


@pytest.fixture(scope="module")
def oracle(tiny):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return db


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, int) else float(v) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tiny, oracle, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        return
    relation = oracle.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    want = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    assert rows == want


def test_entry_module():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
