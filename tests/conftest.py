import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from annotary.runtime import local_session

    return local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as a sorted list of tuples, or a DataFrame of tuples."""

    def make(df, *columns):
        got = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(got, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))

    return make
