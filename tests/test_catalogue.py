import pytest
from compare import differences

from quadrille.plans import catalogue

SLOW = {"rf_oof_probability", "tune_grid"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, sf, name):
    assert differences(spark, sf, catalogue.QUERIES[name], catalogue.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - SLOW))
def test_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalogue.QUERIES) <= set(e.queries())
