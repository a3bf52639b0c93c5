"""Registered queries against their SQL on the driver's smallest tables; the others by rows."""

import pytest

pytest.importorskip("public_tokenizers")
from tallyforge.llm import queries

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, duck, same):
    same(queries.QUERIES[name](spark, SF), duck.execute(queries.ORACLE_SQL[name]).df())


def test_all_are_registered_and_listed_by_the_entry():
    import __spark_entry__

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
