"""Every registered query of the library against its SQL, at the smallest scale."""

import pytest

from tests.compare import duck_rows, spark_rows
from veraframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.ORACLES[name], SF)


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES and not set(catalog.ORACLES) - set(catalog.QUERIES)
