"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from metrum.plans import catalogue
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert differences(df, catalogue.ORACLES[name], SF) == ""
    else:
        assert df.count() > 0


def test_stream_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, catalogue.QUERIES[n](spark, SF).collect()))
    assert rows("stream_regions") == rows("pause_regions")


def test_region_plan_has_one_exchange(spark):
    plan = catalogue.QUERIES["pause_regions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "user_id" in plan and "props" not in plan
