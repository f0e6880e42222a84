"""Every query with SQL against DuckDB over the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(round(v, 7) + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", ["asof_lastk", "entering_state", "event_flags", "best_offer", "odds_math", "brier_logloss", "carryover_roll"])
def test_plans_stay_in_the_jvm_without_cartesian_products(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_scan_prunes_and_pushes(spark, sf_dir):
    from tidemark.sources.readers import safe_scan

    plan = safe_scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_nationkey"], "c_nationkey", 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_nationkey,3)" in plan and "c_acctbal" not in plan.split("ReadSchema")[1]
