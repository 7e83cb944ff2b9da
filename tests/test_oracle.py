"""Every named query against its SQL, at the smallest scale."""

import re

import pytest
from compare import connect, difference
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    own = {name for name in QUERIES if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(SQL) == {"ml_cost_metrics", "ml_score"}


def test_entry(spark):
    assert entry(spark).count() > 10


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None
