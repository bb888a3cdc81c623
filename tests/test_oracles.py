"""Every registered query against its SQL on the small tables; the rest must give rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, oracle_connection

SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    if name in SQLS:
        problems = compare(df, SQLS[name], con)
        assert not problems, "\n".join(problems)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 5
