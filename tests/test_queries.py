"""Every query of the engine against its DuckDB twin."""

import pytest

from hedra.queries import QUERIES, SQL
from tests.compare import duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck(SQL[name], sf))
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
