"""Token and row rules by example."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import receipt_text as rt

PRICES = [
    ("1,99", 2, 199), ("1.234,56", 2, 123456), ("1,234.56", 2, 123456), ("1.234.56", 2, None), ("12", 2, None), ("9,99-A", 2, 999), ("0,15*A", 2, 15), ("-9,83*B", 2, -983), ("2,99A", 2, 299), ("1,00AW", 2, 100),
    ("€12,50", 2, 1250), ("12,50€", 2, 1250), ("01,00", 2, None), ("0,50", 2, 50), ("*198", 0, 198), ("¥1,980", 0, 1980), ("-¥300", 0, -300), ("12345678", 0, None), ("1,2", 0, None), ("3.125", 3, 3125), ("EUR3,00", 2, 300), ("abc", 2, None), ("", 2, None), ("2P", 0, None),
]


def test_price_tokens(spark):
    for exponent in (0, 2, 3):
        rows = [(t, w) for t, e, w in PRICES if e == exponent]
        got = spark.createDataFrame(rows, "t string, want long").select("t", "want", rt.price(F.col("t"), exponent).alias("got")).collect()
        assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_quantities(spark):
    rows = [("2", 2.0), ("0,452kg", 0.452), ("2St", 2.0), ("1.5", 1.5), ("0", None), ("1,2,3", None), ("x", None), ("1234567890", None)]
    got = spark.createDataFrame(rows, "t string, want double").select("want", rt.quantity(F.col("t")).cast("double").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize(
    ("text", "japanese", "month_first", "want"),
    [
        ("2022年9月17日(土)", True, False, "2022-09-17"), ("2022年 9月17日", True, False, "2022-09-17"), ("2015/03/22 10:11", True, False, "2015-03-22"), ("04.05.19", False, False, "2019-05-04"), ("29.04.01", True, False, None),
        ("12/06/09", False, True, "2009-12-06"), ("12/25/2020", False, False, "2020-12-25"), ("10.09.202017:01", False, False, "2020-09-10"), ("2020-02-30", False, False, None), ("gültig bis 01.02.2021", False, False, None), ("1.2.1999", False, False, None), ("2019/11/ 9", False, False, "2019-11-09"), ("no date", False, False, None),
    ],
)
def test_dates(spark, text, japanese, month_first, want):
    got = spark.createDataFrame([(text,)], "t string").select(rt.purchase_date(F.col("t"), F.lit(japanese), F.lit(month_first)).alias("d")).first().d
    assert got == (dt.date.fromisoformat(want) if want else None)


def test_times(spark):
    rows = [("17時28分", "17:28"), ("12:34", "12:34"), ("9:05:33", "09:05"), ("6:00-24:00", None), ("10:00~19:00", None), ("25:10", None), ("営業 10:00", None), ("10.09.202017:01", "17:01"), ("", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", rt.purchase_time(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_votes(spark):
    rows = [(1, "SUMME 12,50 €"), (1, "Danke für Ihren Einkauf"), (1, "BAR 20,00"), (2, "合計 ￥1,980"), (2, "クレジット"), (2, "ありがとう"), (3, "TOTAL $5.00"), (3, "Visa"), (3, "Cash back"), (4, "10 EUR"), (4, "10 USD"), (5, "ALL"), (6, "합계 감사합니다")]
    df = spark.createDataFrame(rows, "receipt_id int, text string")
    codes = spark.createDataFrame([("EUR",), ("USD",), ("ALL",)], "code string")
    assert {r.receipt_id: r.currency for r in rt.currencies(df, codes).collect()} == {1: "EUR", 2: "JPY", 3: "USD", 4: None, 5: None, 6: "KRW"}
    assert {r.receipt_id: r.language for r in rt.languages(df).collect()} == {1: "de", 2: "ja", 3: "en", 4: None, 5: None, 6: "ko"}
    assert {r.receipt_id: r.payment for r in rt.payment_kind(df).collect()} == {1: "cash", 2: "card", 3: None, 4: None, 5: None, 6: None}


def test_kinds_and_rates(spark):
    rows = [("Pfand 0,25", 25, False, "deposit"), ("Wasser inkl. Pfand", 99, False, "article"), ("Pfandbon", 99, False, "article"), ("Rabatt", -5, False, "discount"), ("MwSt", 5, True, "tax")]
    got = spark.createDataFrame(rows, "t string, m long, tax boolean, want string").select("want", rt.item_kind(F.col("t"), F.col("m"), F.col("tax")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    rates = [("MwSt 19% 3,82", 19.0), ("1=19,00%", 19.0), ("7 %", 7.0), ("100%", None), ("none", None)]
    got = spark.createDataFrame(rates, "t string, want double").select("want", rt.vat_rate(F.col("t")).cast("double").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_digit_runs_that_are_no_time_and_returns_that_name_a_deposit(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import receipt_text as rt

    texts = {"123:45": None, "12345:10": None, "1234567:10": None, "9:05": "09:05", "17:01": "17:01", "202017:01": "17:01", "2017:01": "17:01"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.at for r in rows.select("t", rt.purchase_time(F.col("t")).alias("at")).collect()} == texts
    kinds = {"Pfand Voucher": "article", "Pfand Nachlass": "article", "Pfand Preisvorteil": "article", "Pfand Kasten": "deposit", "Pfandbon": "article"}
    rows = spark.createDataFrame([(t,) for t in kinds], "t string")
    assert {r.t: r.kind for r in rows.select("t", rt.item_kind(F.col("t"), F.lit(25), F.lit(False)).alias("kind")).collect()} == kinds
    prices = {"KWD1.234": 1234, "12,500": 12500, "1.234,500": 1234500, "12,50": None, "0,001": 1, "00,001": None}
    rows = spark.createDataFrame([(t,) for t in prices], "t string")
    assert {r.t: r.m for r in rows.select("t", rt.price(F.col("t"), 3).alias("m")).collect()} == prices
