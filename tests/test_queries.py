"""Every registered query against its DuckDB oracle on sf0.001, plus the
adapter counts and the driver entry point."""

import importlib.util
import os

import pytest

from basketlens.plans.registry import load_all
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
REG = load_all()
SQL_QUERIES = sorted(n for n, q in REG.items() if q.sql is not None)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_query_matches_oracle(name, canon_small, con):
    ok, msg = compare(REG[name].build(canon_small), REG[name].sql, con)
    assert ok, msg


def test_adapter_counts_sf001(spark):
    from basketlens.sources.adapter import canon
    c = canon(spark, "/root/testdata/sf0.01")
    got = {r["eval_set"]: (r["n"], r["r"]) for r in
           c.basket.groupBy("eval_set").agg({"*": "count", "reordered": "sum"})
           .withColumnRenamed("count(1)", "n").withColumnRenamed("sum(reordered)", "r").collect()}
    assert got == {"prior": (54019, 457), "train": (3949, 52), "test": (1977, 45)}


def test_entry_smoke(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())
