"""Every registered query against DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from millrace.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if isinstance(v, decimal.Decimal) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query(spark, sf, oracle, key):
    df = catalog.queries()[key](spark, sf)
    got = table(df.columns, df.collect())
    if key in catalog.oracle_sql():
        r = oracle.execute(catalog.oracle_sql()[key])
        assert got == table([d[0] for d in r.description], r.fetchall())
    assert datetime and len(set(df.columns)) == len(df.columns)


def test_filters_reach_the_scan(spark, sf):
    for key, column in (("filter_cmp", "l_quantity"), ("filter_in", "o_orderpriority"), ("filter_between_both", "l_quantity")):
        plan = catalog.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters") :]
        assert column in pushed[: pushed.index("ReadSchema")] and "Python" not in plan


def test_scans_are_pruned(spark, sf):
    plan = catalog.queries()["pricing_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan[plan.index("ReadSchema") :]
