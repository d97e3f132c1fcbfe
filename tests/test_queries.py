"""Every registered query of the library's own operators, against its SQL where it has one."""

import math

import pytest

from loomspan.plans.all_queries import ORACLES, QUERIES
from tests.conftest import SF


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return value


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()]
    assert in_order(got) == in_order(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
