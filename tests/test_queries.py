"""Every query with SQL against DuckDB; the others by their rows."""

import os

import pytest

from corpuscope.plans import all_entries
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = all_entries()

# Slow on few rows; the operator has its own tests.
MODELS = {"forest_predictions"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(set(ENTRIES) - MODELS))
def test_query(spark, con, name):
    entry = ENTRIES[name]
    df = entry.run(spark, SF_DIR)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, entry.sql) == []
