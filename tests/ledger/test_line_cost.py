"""Lines of expenses: no task, window or shuffle that a result doesn't need."""

import re
from decimal import Decimal

from ledgerloom.operators import split
from ledgerloom.operators.receipt_layout import blocks
from ledgerloom.plans import views

from ..conftest import SF_SMALL

LINE = "expense_id long, position long, text string, kind string, quantity decimal(12,6), total_minor long, attached boolean"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, rows):
    return spark.createDataFrame([(*r[:4], Decimal(r[4]), r[5], False) for r in rows], LINE)


def test_halves_need_no_window(spark):
    got = split.split_line(lines(spark, [(1, 1, "a", "article", "3", 100, ), (1, 2, "a", "article", "2", -5), (1, 3, "a", "article", "1.5", 7), (1, 4, "a", "article", "3", -101), (1, 5, "a", "article", "2", 1)]))
    assert "Window" not in plan(got)
    rows = {(r.position, r.half): (str(r.half_quantity), r.half_minor) for r in got.collect()}
    # 100 of weights 2 and 1: 66 and remainder 2, 33 and remainder 1
    assert rows == {(1, 1): ("2.000000", 67), (1, 2): ("1.000000", 33), (2, 1): ("1.000000", -3), (2, 2): ("1.000000", -2), (3, 1): ("0.750000", 4), (3, 2): ("0.750000", 3), (4, 1): ("2.000000", -67), (4, 2): ("1.000000", -34)}


def test_boxes_meet_without_a_join(spark):
    box = [(1, i, 0, t, 10, b, "x") for i, (t, b) in enumerate([(0, 10), (10, 22), (30, 40), (100, 108)])] + [(2, 0, 0, 5, 10, 9, "y")]
    got = blocks(spark.createDataFrame(box, "receipt_id long, idx long, left long, top long, right long, bottom long, text string"))
    assert "Join" not in plan(got)
    assert [(r.receipt_id, r.idx, r.block) for r in got.orderBy("receipt_id", "idx").collect()] == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 1)]


def test_rows_of_a_task_do_not_grow(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(views, "TASK_ROWS", 100)
    large = views.Views(spark, sf).line_item
    n = views.Views(spark, sf).table("lineitem").count() // 100
    assert large.rdd.getNumPartitions() == n > 4
    monkeypatch.undo()
    assert sorted(map(repr, large.collect())) == sorted(map(repr, views.Views(spark, sf).line_item.collect()))


def test_merged_lines_are_not_expanded(spark):
    got = split.merge_lines(lines(spark, [(1, 2, "b", "article", "1", 1), (1, 1, "a", "article", "1", 2), (2, 1, "a", "deposit", "1", 3), (2, 2, "a", "deposit", "2", 4), (3, 1, "a", "deposit", "1", 5), (3, 2, "a", "article", "1", 6), (4, 1, None, "deposit", "1", 7), (5, 1, None, "deposit", "2", 8), (5, 2, "c", "deposit", "2", 9)]), ["expense_id"])
    assert "Expand" not in plan(got)
    rows = {r.expense_id: (r.text, int(r.quantity), r.kind, r.total_minor) for r in got.collect()}
    assert rows == {1: ("a + b", 1, "article", 3), 2: ("a", 3, "deposit", 7), 3: ("a + a", 1, "article", 11), 4: ("", 1, "deposit", 7), 5: ("c", 4, "deposit", 17)}


def test_other_modes_are_left_out_before_lists(spark):
    expense = spark.createDataFrame([(1, "items", 9), (2, "equal", 9)], "expense_id long, split_mode string, total_minor long")
    person = spark.createDataFrame([(1, "a", Decimal(1)), (1, "b", Decimal(2)), (2, "a", Decimal(1))], "expense_id long, person_id string, weight decimal(12,6)")
    held = spark.createDataFrame([(1, 1, "a", Decimal(1)), (2, 1, "a", Decimal(1))], "expense_id long, position long, person_id string, weight decimal(12,6)")
    got = split.itemised(expense, lines(spark, [(1, 1, "x", "article", "1", 6), (2, 1, "x", "article", "1", 9)]), held, person)
    # lines, holders, participants as a list and as rows
    assert plan(got).count("LeftSemi") == 4
    assert {(r.expense_id, r.person_id, r.share_minor) for r in got.collect()} == {(1, "a", 9), (1, "b", 0)}


def test_lines_are_dealt_by_their_own_key_once(spark, monkeypatch):
    """Parts too many to be sent to every task: lines go to their parts, then to their expense."""
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = views.Views(spark, SF_SMALL).line_item
        assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", df._jdf.queryExecution().executedPlan().toString())) == 1
        assert df.rdd.getNumPartitions() and df.columns[:3] == ["expense_id", "position", "text"]
        large = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert large == sorted(map(tuple, views.Views(spark, SF_SMALL).line_item.collect()))
