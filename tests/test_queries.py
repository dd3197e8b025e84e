"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from concord import registry

AT = "/root/testdata/sf0.001"


def rows(found):
    return sorted(repr(tuple(x if isinstance(x, (int, float, bool, str, type(None))) else str(x) for x in r)) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(AT):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{AT}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(AT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, AT)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in registry.oracle_sql():
        names = ", ".join(f'"{c}"' for c in columns)
        assert rows(got) == rows(db.sql(f"SELECT {names} FROM ({registry.oracle_sql()[name]})").fetchall())
