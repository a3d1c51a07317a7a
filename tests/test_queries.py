"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def order(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def test_every_operator_family_is_registered():
    families = {name.split("_")[0][:3] for name in QUERIES}
    assert families >= {"src", "snk", "prj", "flt", "agg", "win", "srt", "set", "str", "dat", "mth", "arr", "prm", "kpi",
                        "evl", "mlj"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, db, folder):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    rows = [tuple(normal(r[c]) for c in columns) for r in frame.collect()]
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    index = [names.index(c) for c in columns]
    other = [tuple(normal(r[i]) for i in index) for r in cursor.fetchall()]
    assert sorted(rows, key=order) == sorted(other, key=order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(name, spark, folder):
    assert QUERIES[name](spark, folder).limit(1).count() == 1
