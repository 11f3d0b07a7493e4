"""Flows of expenses over tables too large to be sent to every task."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balances
from ledgerloom.plans import all_queries, core, views
from ledgerloom.plans.views import Views

from ..conftest import SF_SMALL

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def sorted_joins(spark):
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield
    for k in NO_BROADCAST:
        spark.conf.unset(k)


def test_fallback_where_both_sides_are_sorted(spark, sorted_joins):
    """A join of one union with another had parts of two numbers."""
    got = all_queries()[0]["BAL6_flow_fallback"](spark, SF_SMALL).collect()
    assert got and all(r.amount_minor > 0 and r.from_person != r.to_person for r in got)


def test_expenses_of_a_batch_are_settled_apart(spark):
    share = spark.createDataFrame([(1, "a", -5), (1, "b", 15), (2, "c", 0), (2, "d", -7), (3, "a", 4), (4, "a", -2), (4, "b", 5)], "expense_id long, person_id string, base_minor long")
    payment = spark.createDataFrame([(1, "a", 10), (2, "c", -7), (3, "a", 1), (3, "a", 3), (4, "c", 3)], "expense_id long, person_id string, base_minor long")
    df = balances.flow_fallback(share, payment)
    assert df.columns == ["expense_id", "from_person", "to_person", "amount_minor"]
    assert sorted(map(tuple, df.collect())) == [(1, "b", "a", 15), (2, "c", "d", 7), (4, "b", "a", 2), (4, "b", "c", 3)]
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="sum to zero"):
        balances.flow_fallback(share, payment.limit(0)).collect()


def cells(share, paid):
    """The flows of one expense, cell by cell."""
    total, out = sum(paid.values()), {}
    whole = {(a, b): x * y // total for a, x in share.items() for b, y in paid.items()}
    row = {a: x - sum(whole[a, b] for b in paid) for a, x in share.items()}
    col = {b: y - sum(whole[a, b] for a in share) for b, y in paid.items()}
    re = 0
    for a in sorted(share):
        re, ce = re + row[a], 0
        for b in sorted(paid):
            ce += col[b]
            out[a, b] = whole[a, b] + max(0, min(re, ce) - max(re - row[a], ce - col[b]))
    return {k: x for k, x in out.items() if x}


def test_flows_of_many_expenses_at_once(spark):
    """Amounts of any size, people who come twice, expenses without proportions."""
    big = 4 * 10**18
    rows = [(1, "a", "consumed", 5), (1, "b", "consumed", 6), (1, "c", "consumed", 0), (1, "b", "paid", 4), (1, "d", "paid", 3), (1, "b", "paid", 4)]
    rows += [(2, "a", "consumed", big + 1), (2, "b", "consumed", big), (2, "c", "paid", big), (2, "d", "paid", big + 1)]
    rows += [(3, "a", "consumed", -1), (3, "b", "consumed", 3), (3, "a", "paid", 2), (4, "a", "consumed", 0), (4, "a", "paid", 0), (5, "a", "consumed", 3), (6, "a", "paid", 3)]
    rows += [(7, "a", "consumed", 3), (7, "a", "paid", None), (7, "b", "paid", None), (8, "b", "consumed", 7), (8, "a", "consumed", 3), (8, "z", "paid", 10)]
    df = spark.createDataFrame(rows, "expense_id long, person_id string, kind string, base_minor long").withColumn("group_id", F.lit("g"))
    flows = balances.flows_of_parts(df, ["group_id", "expense_id"])
    got = {(r.expense_id, r.from_person, r.to_person): r.amount_minor for r in flows.collect()}
    want = {(1, *k): x for k, x in cells({"a": 5, "b": 6, "c": 0}, {"b": 8, "d": 3}).items()}
    want |= {(2, *k): x for k, x in cells({"a": big + 1, "b": big}, {"c": big, "d": big + 1}).items()} | {(8, "a", "z"): 3, (8, "b", "z"): 7}
    assert got == want
    assert "Window" not in flows._jdf.queryExecution().optimizedPlan().toString()


def test_flows_stand_on_one_pass(spark):
    """Neither parts nor the texts of lines are written."""
    v = Views(spark, SF_SMALL)
    core.flows(v)
    assert "parts" not in v._kept and v.line_item.columns == core.AMOUNTS


def test_what_a_task_sorts_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    large = core.flows(Views(spark, SF_SMALL))
    assert "RepartitionByExpression [expense_id" in large._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    small = core.flows(Views(spark, SF_SMALL))
    assert "RepartitionByExpression" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
