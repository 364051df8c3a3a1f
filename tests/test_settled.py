"""Frames that come from a join are joined once, however often an operator reads them."""

from plumbline.catalog.base import table
from plumbline.catalog.profiling import _per_lines, _suggest_table
from plumbline.operators import keys

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_of_a_join_are_counted_from_what_was_written(spark, monkeypatch):
    seen, evidence = [], keys.evidence

    def looking(df):
        seen.append("Join" in _plan(df))
        return evidence(df)

    monkeypatch.setattr(keys, "evidence", looking)
    t = lambda name: table(spark, SF, name)
    keys.per_unit_find(_per_lines(t), ["order_total", "quantity"])
    keys.draft_review(_suggest_table(t), {"measures": {"quantity": "sum"}})
    keys.draft_check(_suggest_table(t), {"measures": {"quantity": "sum"}})
    assert seen and not any(seen)
