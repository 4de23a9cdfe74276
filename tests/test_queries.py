"""Every query against its DuckDB counterpart at the smallest size, and the contract of the driver entry."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from frameloom.plans import oracle, scan_queries
from frameloom.plans.queries import QUERIES

ORACLE_SQL = {**oracle.ORACLE_SQL, **scan_queries.ORACLE_SQL}

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4) + 0.0
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.select(*columns).collect()) == canonical(want.fetchall())


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_json_report(spark):
    import json

    rows = QUERIES["json_report"](spark, DATA).collect()
    assert rows and all({"overall", "scores"} == set(json.loads(r["report"])) for r in rows)
