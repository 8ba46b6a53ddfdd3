"""Every registered query with check SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9) + 0.0)
    return str(v)[:26]


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query(spark, duck, name):
    got = entry_point.queries()[name](spark, str(SMALL))
    expected = duck.execute(entry_point.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert lines(got.columns, got.collect()) == lines(names, expected.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


def test_every_check_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
