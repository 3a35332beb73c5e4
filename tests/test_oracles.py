"""Every registered query of the library against its SQL."""

import pytest
from compare import same_rows

from millrace.plans import catalog


def test_each_query_has_sql_or_a_test_of_its_own():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"ivf_topk"}
    assert not set(catalog.ORACLES) - set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, sf, duck):
    same_rows(catalog.QUERIES[name](spark, sf), duck, catalog.ORACLES[name])
