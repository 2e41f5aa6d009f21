"""Every query of the analysis engine against its SQL."""

import pytest
from oracle import expected, rows_of

from stratalens.plans import goldens  # noqa: F401  (adds its queries)
from stratalens.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), expected(ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
