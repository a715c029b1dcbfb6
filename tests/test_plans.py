"""The registered queries: oracle agreement and plan shape."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from reviewops.bindings import TABLES
from reviewops.plans import catalog

from conftest import SF_SMALL

# the corpus queries have their own tests
ORACLE = catalog.oracle_sql()
QUERIES = catalog.queries()
# queries that run actions or streams while being built: checked by value only
EAGER = {k for k in QUERIES if k.startswith("stream_")} | {"nearest_place", "batches", "recheck_batches",
                                                             "score_batch_log", "generic_reply", "ingest_batch",
                                                             "ingest_outputs", "salvage_ingest", "salvage_outputs",
                                                             "etl_stats"}
PYTHON_OK = {"gestalt_ratio": "ArrowEvalPython", "generic_reply": "ArrowEvalPython",
             "ingest_batch": "ArrowEvalPython", "salvage_ingest": "ArrowEvalPython", "score_pairs": "MapInPandas"}


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "store_id" in df.columns and "review_text" in df.columns


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = duck.sql(ORACLE[key]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert r1 == r2


@pytest.mark.parametrize("key", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, key):
    plan = QUERIES[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDF
    for node in ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        if node in plan:
            assert PYTHON_OK.get(key) == node, f"{key} runs Python ({node})"


def test_scan_prunes_columns_and_pushes_filters(spark, tmp_path):
    low = QUERIES["low_star"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<review_id:string,stars:int>" in low
    assert "PushedFilters: [In(stars, [1,2])]" in low
    # an operator over stored columns: the predicate reaches the parquet scan
    from reviewops.operators.filters import geo_box
    path = str(tmp_path / "places")
    spark.createDataFrame([("a", 25.0, 121.5, "x"), ("b", 0.0, 0.0, "y")],
                          "place_id string, lat double, lng double, other string").write.parquet(path)
    plan = geo_box(spark.read.parquet(path), "lat", "lng").select("place_id") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,24.8)" in plan and "LessThanOrEqual(lat,25.3)" in plan
    assert "ReadSchema: struct<place_id:string,lat:double,lng:double>" in plan
