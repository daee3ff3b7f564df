import pytest

from lorekeep.plans import registry
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_what_its_sql_gives(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in SQL:
        assert_same(df, SQL[name], SF)
    else:
        assert df.columns and df.count() >= 0


def test_entry_and_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "dql_table_filter_sort" in e.queries()
