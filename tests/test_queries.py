"""Every registered query against its SQL in DuckDB, on the same Parquet tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from chronoweave.queries import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = registry()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, float | decimal.Decimal):
        return f"{float(x):.5f}".replace("-0.00000", "0.00000")
    if isinstance(x, datetime.datetime | str | bool | int):
        return str(x)
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query_equals_sql(spark, con, name):
    df = REGISTRY.queries[name](spark, SF)
    got = table([tuple(r) for r in df.collect()], df.columns)
    found = con.execute(REGISTRY.sql[name])
    columns = [d[0] for d in found.description]
    want = table(found.fetchall(), columns)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql) - {"ml2_cross_validation", "ml3_label_units"}))
def test_query_without_sql_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, SF).limit(1).count() == 1
