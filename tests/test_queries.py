"""Every registered query of the fact engine against its SQL."""

import pytest

from factloom.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, duck, rows_of


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows_of(got) == rows_of(con.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
