"""The registered queries beside their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.compare import rows_of
from wickerlane.plans import registry



@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


#: Names of the same plan are run once.
NAMES = {registry.QUERIES[n]: n for n in sorted(registry.SQL, reverse=True)}


@pytest.mark.parametrize("name", sorted(NAMES.values()))
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = db.execute(registry.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer_id", "article_id", "pos"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
