"""Every core query against its SQL on the smallest tables."""

import math

import pytest

from kelpie.plans.queries import oracle_sql, queries


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return str(x)


def compare(spark, duck, data, query, sql):
    df = query(spark, data)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    theirs = sorted(tuple(norm(row[i]) for i in at) for row in rel.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, data, name):
    compare(spark, duck, data, queries()[name], oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    assert queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
