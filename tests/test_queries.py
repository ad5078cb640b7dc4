"""Every registered transaction query, the ones with an oracle against DuckDB, at the smallest scale."""

import math
import os

import pytest

from quern.operators import gold
from quern.plans import catalog, oracle  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.6f}" if isinstance(v, (int, float)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    import duckdb

    got = catalog.QUERIES[name](spark, DATA)
    values = got.collect()
    if name not in catalog.ORACLE:
        return
    con = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, want.fetchall())


def test_explorer_without_limit(spark):
    """All rows, and no limit or order in the plan, so that no task keeps its rows in memory."""
    fct = spark.range(300).selectExpr("lpad(id, 3, '0') AS transaction_id", "'m' AS merchant_id", "if(id % 3 = 0, 'SQ *ACE', 'x') AS raw_descriptor", "'exact' AS match_method", "1.0D AS match_confidence")
    dim = spark.createDataFrame([("m", "Blue Barn", "5001", "c"), ("m", "Blue Barn", "5002", "c")], "merchant_id string, merchant_name string, mcc string, merchant_category string")
    assert gold.explore(fct, dim, least=0.5, term="a%e", limit=None).count() == 200
    first = gold.explore(fct, dim, least=0.5, term="a%e", limit=3).select("transaction_id", "mcc").collect()
    assert [tuple(r) for r in first] == [("000", "5001"), ("000", "5002"), ("003", "5001")]
    plan = catalog.QUERIES["flt_13"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
