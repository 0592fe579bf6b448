import pytest

from compare import rows_of
from trimodel.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names, want = duck(ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
