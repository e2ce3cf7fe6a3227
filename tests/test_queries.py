"""Every published query on the smallest tables, against its SQL where there is one."""

import math
from decimal import Decimal

import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("p") or not n[1:2].isdigit() or n in ORACLE))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in ORACLE:
        return
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)
