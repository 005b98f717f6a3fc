"""Every registered query against its SQL oracle on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    status, n = compare(spark, duck, SF, name)
    assert status.startswith(("ok", "rows-only")), status
    assert n > 0


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_oracles_name_known_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["departures", "kin_left", "sri_presence", "csi", "contrasts", "model_frame", "rate_per_entity"])
def test_plans_hold_no_cross_product(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_departures_and_stays_add_up(spark):
    from rollcall.operators.transitions import transitions
    from rollcall.plans import base as b

    p = transitions(b.presence(spark, SF), "entity", "day", "departure").filter("present_pre = 1")
    left, stayed = p.filter("departure = 1").count(), p.filter("departure = 0").count()
    assert left + stayed == p.count() and left == p.filter("present = 0").count()


def test_rates_cover_every_exposure_day(spark):
    from rollcall.plans import base as b

    assert queries()["rate_zero_fill"](spark, SF).count() == b.mgd(spark, SF).count()
