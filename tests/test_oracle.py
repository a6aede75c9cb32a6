"""Every registered query with SQL of its own, against DuckDB on the same tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from marlstone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert ours == theirs


def test_every_query_but_the_whole_state_machine_has_sql():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"gate_outcomes"}


def test_no_query_takes_the_name_of_another():
    assert len(catalogue.QUERIES) == sum(len(part.QUERIES) for part in catalogue._PARTS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
