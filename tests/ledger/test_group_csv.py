"""Wide lines of groups with many members."""

import datetime as dt
import re

from pyspark.sql import functions as F

from ledgerloom.sources import writers


def test_only_those_who_take_part_are_looked_at(spark):
    expense = spark.createDataFrame([("g", 1, dt.date(2024, 1, 1), "2024-01-01T09:30:00", "food", 300), ("g", 2, dt.date(2024, 1, 2), "2024-01-02T10:00:00", None, 5)], "group_id string, expense_id long, occurred_date date, occurred_at string, category_id string, total_base_minor long")
    items = spark.createDataFrame([(1, 1, "Brot; hell", 300)], "expense_id long, position long, text string, total_minor long")
    paid = spark.createDataFrame([("g", 1, "p2", 100), ("g", 1, "p2", 200)], "group_id string, expense_id long, person_id string, base_minor long")
    share = spark.createDataFrame([("g", 1, "p2", 50), ("g", 1, "p5", 250), ("g", 1, "gone", 0)], "group_id string, expense_id long, person_id string, base_minor long")
    member = spark.range(1, 7).select(F.lit("g").alias("group_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("person_id"), F.col("id").alias("idx"))
    lines = writers.group_lines(expense, items, share, paid, member)
    said = {r.line_no: r.line for r in lines.collect()}
    none = ["", ""]
    assert said[0].split(";")[4:8] == ["p1 paid", "p1 share", "p2 paid", "p2 share"] and said[0].endswith("gone paid;gone share")
    assert said[1] == ";".join(["expense", "2024-01-01 09:30", "food", "3,00", *none, "3,00", "0,50", *none, *none, "", "2,50", *none, "", "0,00"])
    assert said[2] == 'item;;"Brot; hell";3,00' and said[3] == ";".join(["expense", "2024-01-02 10:00", "", "0,05", *(none * 7)])
    # no expense meets people who have nothing to do with it
    assert not re.search(r"Join LeftOuter, .*person_id", lines._jdf.queryExecution().optimizedPlan().toString())
