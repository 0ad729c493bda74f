"""Every query with SQL gives what the SQL gives."""

import datetime
import decimal
import math
from collections import Counter

import duckdb
import pytest

from assize.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def norm(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0 if math.isfinite(value) else str(value)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, folder, duck, name):
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    expected = Counter(tuple(norm(row[k]) for k in place) for row in relation.fetchall())
    found = Counter(tuple(norm(row[c]) for c in columns) for row in df.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_others_run(spark, folder, name):
    assert catalogue.QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
