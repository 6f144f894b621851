"""Every registered query next to its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    by_name = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(None if row[i] is None else str(row[i]) for i in by_name) for row in rows]
    return sorted(columns), sorted(shown, key=lambda r: tuple((v is None, v or "") for v in r))


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    got = ordered(frame.columns, frame.collect())
    answer = db.execute(entry.oracle_sql()[name])
    assert got == ordered([d[0] for d in answer.description], answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
