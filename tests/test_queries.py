"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cipherscope.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def ordered(rows):
    plain = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, data, name):
    frame = QUERIES[name](spark, data)
    result = db.sql(SQL[name])
    names = sorted(frame.columns)
    assert sorted(result.columns) == names
    at = [result.columns.index(n) for n in names]
    expected = ordered(tuple(r[i] for i in at) for r in result.fetchall())
    assert ordered(tuple(r[n] for n in names) for r in frame.collect()) == expected
    assert expected or name == "query_filter_exact"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
