import pytest
from compare import duck_rows, spark_rows

from assayframe import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(name, spark, duck, sf_dir):
    names, rows = spark_rows(catalogue.queries()[name](spark, sf_dir))
    if name in SQL:
        assert (names, rows) == duck_rows(duck, SQL[name])
    else:
        assert rows


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())
