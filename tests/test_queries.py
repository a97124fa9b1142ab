"""Every query that has SQL against DuckDB's answer to it, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return float(f"{v:.10g}")
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    found = duck.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    want = sorted(str([plain(row[k]) for k in order]) for row in found.fetchall())
    assert sorted(str([plain(x) for x in row]) for row in got.collect()) == want


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
