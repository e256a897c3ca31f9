import pytest
from conftest import SF, same

from corvane.plans import contract_queries, fidelity_queries, index_queries, model_queries, queries, stream_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck.execute(queries.SQL[name]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
