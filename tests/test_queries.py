"""Every query against its SQL; queries without one must give rows."""

import pytest

from tallyforge import catalog

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, same):
    found = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        same(found, duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert found.count() > 0


def test_only_simulation_and_iteration_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"dst05_coalition_simulation", "dst06_baseline_simulation"}


def test_entry_gives_the_flagship(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and {"brier", "ece", "n"} <= set(found.columns)
