"""Every deterministic query against its SQL counterpart."""

import pytest
from compare import connect, difference

from dialgauge.catalog.oracle import oracle_texts
from dialgauge.catalog.queries import QUERIES

ORACLE = oracle_texts()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_only_model_fits_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {
        "gbt_deep_ensemble",
        "gbt_shallow_ensemble",
        "mlp_single_table",
        "gbt_regression_single_table",
    }
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, con, name):
    assert difference(QUERIES[name](spark, small), con, ORACLE[name]) is None
