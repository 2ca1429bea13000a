"""The driver's contract, and every query of the core that has SQL against it."""

import os

import pytest
from sql_check import DATA, differences

import __spark_entry__ as entry
from annotary.plans import general, pipeline


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pmid", "rnk", "label", "score"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(pipeline.ORACLE | general.ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, name) == (0, 0)
