import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "score" in df.columns
