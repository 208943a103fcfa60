"""Every query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import rows_of

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Fits take half a minute each: they have their own tests.
SLOW = {n for n in QUERIES if n.startswith("model_")}


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLE) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
