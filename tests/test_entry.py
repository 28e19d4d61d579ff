"""Every registered query equals its SQL; those without are held against plain versions."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIBRARY = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")
WITH_SQL = [n for n in LIBRARY if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(x) else f"{x:.9g}"


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", WITH_SQL)
def test_query(spark, duck, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_have_a_plain_version():
    held = (Path(__file__).parent / "test_plain_versions.py").read_text()
    assert [n for n in LIBRARY if n not in WITH_SQL and f'"{n}"' not in held] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
