"""Every registered query runs; oracle-checked ones equal DuckDB at sf0.001 (the driver checks sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from tabsmith.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

load_all()
SF = "/root/testdata/sf0.001"
FAST = sorted(n for n in ORACLES if n not in {"tfidf_weights"})


@pytest.fixture(scope="module")
def con():
    from check_oracles import duck

    return duck(SF)


DUCK_TYPE = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
             "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    from check_oracles import compare

    info = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert info["status"] == "ok", info
    # same column types on both sides, so a type-aware value hash agrees too
    sdf = QUERIES[name](spark, SF)
    duck_types = {d[0]: str(d[1]) for d in con.execute(ORACLES[name]).description}
    spark_types = {f.name: DUCK_TYPE.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    assert spark_types == duck_types


def test_entry_smoke(spark):
    import importlib.util

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(here, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() >= 1 and df.columns == ["check_order", "check", "column", "passed", "detail"]
    assert set(mod.oracle_sql()) <= set(mod.queries())


SLOW = {"evaluate_regression", "evaluate_binary"}  # boosted trees at their full budget


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1
