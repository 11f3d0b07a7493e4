"""Payment methods, numbered lines and histories on small hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.operators import fx, methods
from ledgerloom.operators.numbering import lines_by_bucket, lines_of_all
from ledgerloom.operators.receipt_layout import details
from ledgerloom.operators.validate import missing_reference, receipts_held_twice

METHOD = "method_id string, kind string, name string, owner string, archived boolean, deleted boolean"
PERSON = "person_id string, name string, is_me boolean, deleted boolean"


def people(spark):
    return spark.createDataFrame([("p1", "Zoe", True, False), ("p2", "ann", False, False), ("p3", "Bob", False, True)], PERSON)


def wallet(spark, rows=None):
    rows = rows if rows is not None else [("a", "card", "Visa", "p1", False, False), ("b", "cash", "Purse", "p1", False, False), ("c", "card", "Old", "p1", True, False), ("d", "card", "Gone", "p1", False, True),
                                          ("e", "card", "amex", "p2", False, False), ("f", "card", "Dead owner", "p3", False, False), ("g", "card", "Shared", None, False, False), ("h", "cash", "Till", None, False, False)]
    return spark.createDataFrame(rows, METHOD)


def test_owners_and_order(spark):
    assert {(r.owner, r.method_id) for r in methods.own_methods(wallet(spark), people(spark)).collect()} == {("p1", "a"), ("p1", "b"), ("p2", "e")}
    assert {(r.owner, r.method_id) for r in methods.withdrawal_cards(wallet(spark), people(spark)).collect()} == {("p1", "a"), ("p2", "e"), (None, "g")}
    rows = methods.all_methods(wallet(spark), people(spark)).orderBy("line").collect()
    assert [r.method_id for r in rows] == ["b", "a", "c", "e", "g", "h"] and [r.line for r in rows] == [1, 2, 3, 4, 5, 6]
    assert methods.all_methods(wallet(spark, []), people(spark)).count() == 0


def test_method_that_a_receipt_suggests(spark):
    usable = methods.visible(wallet(spark), people(spark)).where("NOT archived")
    wanted = spark.createDataFrame([(1, "p1", "card", "a"), (2, "p1", "card", "b"), (3, "p2", "cash", "b"), (4, "p2", "card", "a"), (5, "p9", "card", None), (6, "p1", None, "a")], "n int, person_id string, payment string, current string")
    last = spark.createDataFrame([("p1", "g")], "person_id string, last string")
    got = {r.n: r.method for r in methods.method_for_payment(wanted, usable, last).collect()}
    # current; last one, everybody's; everybody's cash; another's card is not taken; unknown person; no kind known
    assert got == {1: "a", 2: "g", 3: "h", 4: "e", 5: "g", 6: None}


def test_withdrawals_are_what_was_charged(spark):
    currency = spark.createDataFrame([("EUR", 2), ("JPY", 0), ("USD", 2)], "code string, exponent int")
    archive = spark.createDataFrame([("r1", "EUR", "JPY", "160"), ("r2", "EUR", "USD", "1.25")], "id string, base string, quote string, rate string").withColumn("rate", F.col("rate").cast("decimal(28,10)"))
    rows = [(1, "JPY", 16000, "r1"), (2, "EUR", 1000, "r2"), (3, "JPY", 500, "r2"), (4, "JPY", 500, None), (5, "JPY", 500, "unknown"), (6, None, 7, "r1")]
    got = methods.charged(spark.createDataFrame(rows, "id int, currency string, amount_minor long, fx_rate_id string"), archive, currency).collect()
    assert {r.id: (r.charged_minor, r.charged_currency) for r in got} == {1: (10000, "EUR"), 2: (1250, "USD"), 3: (500, "JPY"), 4: (500, "JPY"), 5: (500, "JPY"), 6: (7, None)}


def test_lines(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = lines_by_bucket(df, ["g"], F.col("v"), [F.desc("id")]).collect()
    for g in range(3):
        want = sorted((i for i in range(1000) if i % 3 == g), key=lambda i: (i % 7, -i))
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.line)] == want
    # ties and a hot value
    many = df.withColumn("v", F.when(F.col("id") < 900, 1).otherwise(F.col("v")))
    lines = {r.id: r.line for r in lines_of_all(many, [F.desc("v"), F.col("id")], ranges=5).collect()}
    want = sorted(range(1000), key=lambda i: (-(1 if i < 900 else i % 7), i))
    assert [lines[i] for i in want] == list(range(1, 1001))


def test_histories(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [("a1", "EUR", "JPY", 160, d(1), 1, "main"), ("a2", "EUR", "JPY", 161, d(3), 1, "main"), ("a3", "EUR", "JPY", 162, d(3), 2, "backup"), ("b1", "EUR", "GBP", 2, d(2), 1, "main"), ("b2", "GBP", "EUR", 4, d(4), 1, "main"),
            ("m", "JPY", "GBP", 5, d(2), 9, "manual"), ("k1", "EUR", "USD", 1, d(1), 1, "main"), ("k2", "EUR", "USD", 1, d(1), 5, "main"), ("n", "EUR", "USD", 1, None, 5, "manual")]
    archive = spark.createDataFrame(rows, "id string, base string, quote string, rate int, rate_date date, fetched_at long, source string").withColumn("rate", F.col("rate").cast("decimal(28,10)"))
    pairs = spark.createDataFrame([("JPY", "GBP"), ("GBP", "JPY"), ("EUR", "USD"), ("EUR", "EUR"), ("XXX", "JPY")], "from_cur string, to_cur string")
    got = {}
    for r in fx.histories(archive, pairs).orderBy("line").collect():
        got.setdefault((r.from_cur, r.to_cur), []).append(("+".join(r.legs), r.source, round(float(r.num / r.den), 9)))
    # day 4: b2 came; day 3: the newer fetch of the leg; day 2: a manual line, then the cross
    assert got["JPY", "GBP"] == [("a3+b2", "backup + main", round(1 / 162 / 4, 9)), ("a3+b1", "backup + main", round(2 / 162, 9)), ("m", "manual", 5), ("a1+b1", "main", 2 / 160)]
    assert [x[0] for x in got["GBP", "JPY"]] == ["b2+a3", "b1+a3", "m", "b1+a1"]
    assert [x[0] for x in got["EUR", "USD"]] == ["k2", "n"] and len(got) == 3
    few = fx.histories(archive, pairs, cap=2).where("from_cur = 'JPY'").orderBy("line").collect()
    assert [r.legs for r in few] == [["a3", "b2"], ["a3", "b1"]]
    assert fx.histories(archive.where("false"), pairs).count() == 0


def test_details_of_a_receipt(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 0, None, "09:00"), (1, 3, d, None), (1, 4, None, "10:00"), (1, 2, None, "11:00"), (2, 5, None, "12:00"), (2, 7, None, "13:00"), (3, 0, None, None)]
    got = {r.receipt_id: (r.day, r.time) for r in details(spark.createDataFrame(rows, "receipt_id int, row int, day date, time string")).collect()}
    assert got == {1: (d, "11:00"), 2: (None, "12:00"), 3: (None, None)}


def test_references(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "n int, method string")
    target = spark.createDataFrame([("a",), ("a",)], "id string")
    assert [r.n for r in missing_reference(df, target, "method", "id").collect()] == [3]
    held = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (4, None), (5, None)], "expense_id int, receipt_id int")
    assert [(r.receipt_id, r.held) for r in receipts_held_twice(held).collect()] == [(7, 2)]
