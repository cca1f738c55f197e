"""Every registered query runs, and gives the rows of its checking SQL on DuckDB."""

import decimal
import os

import duckdb
import pytest

from pagewright.plans import bodies, contacts, flagship, joins, operations, streams, tables, texts, vectors  # noqa: F401
from pagewright.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    view = lambda rows, pick: sorted((tuple(plain(pick(r, c)) for c in order) for r in rows), key=repr)
    assert view(got, lambda r, c: r[c]) == view(want, lambda r, c: r[columns.index(c)])


def test_entry_point():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_here_imports_the_training_part():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent
    for f in [*root.glob("pagewright/**/*.py")]:
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f


def test_throttle_reads_times_to_the_nearest_millisecond(spark, duck, tmp_path):
    """F1: the SQL rounds microseconds, so 999.6 ms are the next second."""
    duck.execute(f"""COPY (SELECT (i * 7 % 400)::BIGINT AS event_id, (i % 3)::BIGINT AS user_id, make_timestamp(1700000000000000 + i * 1000000 + CASE i % 4 WHEN 0 THEN 999499 WHEN 1 THEN 999500 WHEN 2 THEN 999999 ELSE 0 END) AS ts
      FROM range(400) t(i)) TO '{tmp_path}/events.parquet'""")
    want = duck.execute(ORACLES["domain_throttle"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["domain_throttle"](spark, str(tmp_path)).collect())) == sorted(want)
