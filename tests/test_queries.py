"""Every registered query against its SQL statement on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# model fits are covered by test_models and the benchmark; here they only cost time
SLOW = {"tune", "ablation", "base_models", "feature_importance", "focal_second_pass"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, sf_dir, name):
    problem, rows, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert problem is None
    assert rows >= 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["user_id", "risk_score", "risk_level"] and df.count() == 10
