"""The registered queries against their SQL on the small tables, and the driver's contract."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle(sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    return v.normalize() + 0 if isinstance(v, decimal.Decimal) else v


def rows_of(rows, columns, order):
    index = [columns.index(c) for c in order]
    return sorted((tuple(norm(r[i]) for i in index) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    got = oracle.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    assert rows_of(df.collect(), df.columns, order) == rows_of(got.fetchall(), columns, order)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
