"""Every library query against its SQL on the smallest tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__
from tallyloom.plans import catalog, runs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, dt.datetime):
        return v.date() if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) else v
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols and got == want


def test_planted_leaks_are_found(spark):
    assert [r.verdict for r in catalog.QUERIES["score_planted"](spark, SF).collect()] == ["ok"]


def test_vocabularies_are_held_against_whole_tables(spark):
    got = {(r.name, r.value): r.n for r in catalog.QUERIES["vocabulary_checks"](spark, SF).collect()}
    f, c = runs.tables.run_findings(spark, SF), runs.tables.clauses(spark, SF)
    assert got["status", "unverified"] + got["status", "needs_review"] == f.filter("status NOT IN ('confirmed', 'false_positive')").count() > 0
    assert got["method", "fuzzy"] - c.filter("method = 'fuzzy'").count() == 0 < got["method", "failed"] == c.filter("method = 'failed'").count()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 4
