"""Every registered query of the core against its SQL twin on the smallest tables."""

import glob
import importlib
import os
import sys

import pandas as pd
import pytest

import __spark_entry__ as entry
from depweft.plans import data_quality, domain_queries, graph_queries, inventory_queries, table_queries

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
MODULES = (data_quality, graph_queries, domain_queries, inventory_queries, table_queries)
QUERIES = {n: q for m in MODULES for n, q in m.queries().items()}
SQL = {n: s for m in MODULES for n, s in m.oracle_sql().items()}


#: Queries without twin: the test that holds their operator against a model.
MODELS = {
    "p3_levels": ("test_shred", "test_round_trip"),
    "p4_parameters_typed": ("test_pivot", "test_one_row_per_entity"),
    "p4_variables_typed": ("test_pivot", "test_one_row_per_entity"),
    "p5_mixture": ("test_moments", "test_expectation_maximisation_counts"),
}


def normal(rows):
    return sorted(tuple("" if x is None or x is pd.NA or x != x else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        module, model = MODELS[name]
        assert hasattr(importlib.import_module(module), model), "a query without a twin needs a model"
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert normal(got[order].astype(object).itertuples(index=False, name=None)) == normal(want[order].astype(object).itertuples(index=False, name=None))


def test_contract(spark, data):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    if data == "/root/testdata/sf0.001":
        assert entry.entry(spark).count() > 0
