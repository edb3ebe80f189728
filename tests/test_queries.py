"""Every query of the core against its SQL, and its schema where SQL cannot say it."""

import math

import pytest

from tidewave.registry import ORACLE_SQL, QUERIES


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    said = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == columns
    assert mine == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in said.fetchall())
    assert mine


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if "equal" in rows[0]:
        assert all(r["equal"] for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
