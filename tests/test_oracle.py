"""Every registered query against its DuckDB oracle (the driver's check)."""

import os

import pytest

from fixtures_data import SF_SMALL

import __spark_entry__ as E
from qoeflow.plans.catalog import REGISTRY
from oracle_check import compare

NAMES = sorted(REGISTRY)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    if not os.path.exists(SF_SMALL):
        pytest.skip("no test data")
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.startswith("ok"), res


def test_every_query_has_an_oracle():
    missing = set(REGISTRY) - set(E.oracle_sql())
    assert not missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["group_id", "slots"]
    assert df.count() > 0
