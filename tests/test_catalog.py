"""Every query runs, and equals its SQL where it has one."""

import math

import pytest
from common import SF

from lectern import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def table(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        r = duck.sql(SQL[name])
        assert got == table(r.columns, r.fetchall())
    else:
        assert got[0]


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_chunks_alike(spark):
    one, two = (table(d.columns, [tuple(r) for r in d.collect()]) for d in (QUERIES[n](spark, SF) for n in ("chunks_packed", "chunks_by_book")))
    assert one == two


def test_limiter_alike(spark):
    got = [table(d.columns, [tuple(r) for r in d.collect()]) for d in (QUERIES[n](spark, SF) for n in ("rate_limiter", "rate_limiter_fold", "stream_rate_limiter"))]
    assert got[0] == got[1] == got[2]
