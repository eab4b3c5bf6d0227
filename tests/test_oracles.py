"""Every registered query against its SQL on the small tables."""

import pytest

from aerolith.plans.catalog import ORACLE_SQL, QUERIES

from .compare import duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    names, got = spark_rows(QUERIES[name](spark, DATA))
    sql_names, wanted = duck_rows(ORACLE_SQL[name], DATA)
    assert names == sql_names
    assert len(got) == len(wanted)
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
