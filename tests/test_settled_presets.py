"""The rows of a preset are joined once, however many steps read them."""

from plumbline.catalog.base import table
from plumbline.catalog.presets import SHIP_BOUND, shipments
from plumbline.plans.runner import Request, run_preset

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_steps_of_a_preset_do_not_join_again(spark):
    df = shipments(lambda t: table(spark, SF, t))
    assert "Join" in _plan(df)
    steps = run_preset("logistics.courier_compare", Request(df, {**SHIP_BOUND, "courier": "zone", "zone": "courier"}))
    lazy = [_plan(s.frame) for s in steps if s.analysis == "cross_tab"]
    assert lazy and not any("Join" in p for p in lazy)
