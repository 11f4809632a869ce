"""The registered queries of the patterns library against their SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from facetmill.plans import oracles
from facetmill.plans.queries import QUERIES

SLOW = {"maximal_four_tables"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted((tuple(round(x, 5) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(oracles.SQL) - SLOW))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert canonical(tuple(r[c] for c in columns) for r in df.collect()) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
