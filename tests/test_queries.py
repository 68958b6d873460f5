"""Every registered query at the smallest scale against its DuckDB statement."""

import collections
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from cohortloom.plans import catalog
from cohortloom.plans.steps import lease
from oracles import ORACLES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def shared_steps(spark):
    """Queries share the steps they write, as in one session of analysis."""
    with lease(spark):
        yield


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{float(v):.9g}")
    return v if isinstance(v, bool) else str(v)


def bag(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(canonical(r[i]) for i in order) for r in data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, db, name):
    df = entry.queries()[name](spark, str(FOLDER))
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    res = db.execute(entry.oracle_sql()[name])
    assert got == bag([d[0] for d in res.description], res.fetchall())
