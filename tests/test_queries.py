"""Queries over the smallest tables, held against their SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from twinframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/**/*.parquet' if os.path.isdir(p) else p}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES)[:: int(os.environ.get("TEST_EVERY", "1"))])
def test_against_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = db.execute(queries.ORACLES[name])
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert columns == [found.description[i][0] for i in order]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_path_query_reads_one_table_and_two_columns(spark):
    plan = __spark_entry__.queries()["aasql_eq_str"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "p_brand" in plan and "lineitem" not in plan and "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#2)]" in plan
