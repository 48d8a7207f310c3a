"""Every registered query runs on the smallest tables and gives the rows of its SQL; nothing leaks into the optional part."""

from __future__ import annotations

import math
import os
import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from drawlake.plans import REGISTRY
from drawlake.plans.coverage import false_claims, traced

DATA = "/root/testdata/sf0.001"
#: The library functions that each query called.
CALLS: dict[str, set[str]] = {}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    df, CALLS[name] = traced(lambda: q.run(spark, DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if q.sql:
        r = con.execute(q.sql)
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())


def test_claims_are_run():
    """What COVERAGE.md and the registry say a query shows, it runs."""
    if len(CALLS) < len(REGISTRY):
        pytest.skip("not all queries were run")
    assert false_claims(CALLS, {n: q.operators for n, q in REGISTRY.items()}) == []


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(REGISTRY) <= set(e.queries())


def test_no_cartesian_product_outside_single_rows(spark):
    for name, q in REGISTRY.items():
        plan = q.run(spark, DATA)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name


def test_library_does_not_import_the_optional_part():
    root = Path(__file__).resolve().parents[1] / "drawlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"drawlake\.llm|corpus_pipeline", p.read_text()), p


def test_filters_and_columns_reach_the_scan(spark):
    plan = REGISTRY["filter_scoped_optional"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(user_id,7)" in plan and "props" not in plan
    assert "text" not in REGISTRY["scan_prune"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
