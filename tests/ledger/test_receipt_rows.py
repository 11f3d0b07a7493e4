"""Rows, marks, keywords and shops of receipts by example."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import receipt_marks as m
from ledgerloom.operators import receipt_quality as quality
from ledgerloom.operators import receipt_rows

SF = "/root/testdata/sf0.001"
BOX = "receipt_id long, idx long, left long, top long, right long, bottom long, text string"
# receipt: boxes in reading order of the engine, rows expected
PRINTED = {
    1: ([(905, 605, 1043, 660, "2,79 A"), (250, 560, 620, 608, "Tomaten rund"), (908, 562, 1040, 610, "1,29 A"), (250, 606, 640, 655, "Oliven schwarz")], ["Tomaten rund 1,29 A", "Oliven schwarz 2,79 A"]),
    2: ([(10, 200, 280, 246, "Laib"), (570, 214, 660, 258, "2,49"), (10, 258, 290, 302, "Rahm")], ["Laib 2,49", "Rahm"]),
    # two prices that overlap stay in rows of their own
    3: ([(5, 300, 250, 348, "Kiste A"), (500, 309, 590, 357, "-1,25"), (500, 338, 590, 386, "-9,83"), (5, 350, 250, 398, "Kiste B")], ["Kiste A -1,25", "Kiste B -9,83"]),
    # the price column is lifted by 36, nearer to the name above
    4: ([(0, 70 * k - 36, 400, 70 * k + 36, f"Ware {w}") for k, w in enumerate("abcdefg")] + [(700, 70 * k - 36 - 37, 830, 70 * k - 36 + 37, f"{k},00") for k in range(1, 7)], ["Ware a", *(f"Ware {w} {k},00" for k, w in enumerate("bcdefg", 1))]),
    5: ([(600, 100, 700, 140, "2,49"), (0, 150, 300, 190, "Milch"), (0, 100, 300, 140, "Brot")], ["Brot 2,49", "Milch"]),
    6: ([(0, 0, 10, 10, "  "), (0, 20, 10, 30, "A"), (0, 40, 10, 50, None)], ["A"]),
    7: ([(0, 10, 5, 10, "a"), (6, 10, 9, 10, "b")], ["a", "b"]),
}


def test_printed_rows(spark):
    boxes = [(r, i, *b) for r, (bs, _) in PRINTED.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(boxes, BOX).repartition(3).withColumn("line", F.lit("clash")).withColumn("block", F.lit("clash"))
    got = {}
    for r in sorted(receipt_rows.text_rows(df).collect(), key=lambda r: (r.receipt_id, r.row_no)):
        got.setdefault(r.receipt_id, []).append(r.text)
    assert got == {r: rows for r, (_, rows) in PRINTED.items()}
    first = receipt_rows.text_rows(df).where("receipt_id = 1 and row_no = 0").first()
    assert (first.left, first.top, first.right, first.bottom) == (250, 560, 1040, 610)
    places = sorted((r.row_no, r.place, r.idx) for r in receipt_rows.printed_rows(df).where("receipt_id = 5").collect())
    assert places == [(0, 0, 2), (0, 1, 0), (1, 0, 1)]
    assert receipt_rows.text_rows(spark.createDataFrame([], BOX)).count() == 0


def test_row_keywords(spark):
    want = {
        "SUMME EUR 34,09": "total", "E Summe 34,09": "total", "Zw.-Summe 3,00": "subtotal", "Zw Summe 3,00": "subtotal", "zu zahlen": "total", "GEGEBEN: 50,00": "payment", "Rückgeld 1,00": "change", "合計 1点 ¥330": "total",
        "2 点": None, "小 計 712": "subtotal", "お預り合計 1000": "payment", "nanaco支払 ¥1,294": "payment", "時計 500": None, "620 計": "total", "Brot 1,99": None, "": None, None: None,
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", m.row_keyword(F.col("t"), 2).alias("k")).collect()
    assert {r.t: r.k for r in got} == want


@pytest.mark.parametrize(("text", "name", "address", "firm"), [
    ("EDEKA Hornung", True, False, None), ("Hauptstraße 115", False, True, None), ("37355 Niederorschel", False, True, None), ("IKEA Deutschland GmbH & Co.KG", True, False, "IKEA Deutschland"),
    ("Smyths Toys SE & Co. KG", True, False, "Smyths Toys"), ("www.markt.de", False, False, None), ("Tel. 04941", False, False, None), ("GmbH", True, False, None), ("株式会社アントワークス", False, False, None), ("", False, False, None),
])
def test_header_rows(spark, text, name, address, firm):
    got = spark.createDataFrame([(text,)], "t string").select(m.name_like(F.col("t")).alias("n"), m.address(F.col("t")).alias("a"), m.company(F.col("t")).alias("c")).first()
    assert (got.n, got.a, got.c) == (name, address, firm)


def _rows(df, names):
    return sorted(tuple(str(r[n]) for n in names) for r in df)


@pytest.mark.parametrize("name", ["RC1_printed_rows", "RC3_text_rows", "RC6_marks", "RC7_context", "RC8_row_keyword", "RC12_returns", "RC20_merchant", "RC26_quality_report", "RC27_recognition"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert _rows(entry.queries()[name](spark, SF).collect(), names) == sorted(tuple(map(str, r)) for r in want.fetchall())


def test_matching_and_scores():
    # a price goes to the first free total, then to the first free unit price
    assert quality.matched([300, 300, 680, 5], [(300, None), (680, 300), (680, None)]) == 3
    assert quality.matched([], [(1, 1)]) == 0
    assert quality.shows_price("Brot 9, 99 A", "9,99") and quality.shows_price("合計 ¥1,234円", "1,234") and quality.shows_price("EUR9,99", "9,99")
    assert not quality.shows_price("Brot 19,99", "9,99") and not quality.shows_price("", "9,99")
    assert quality.similarity("Ｂｒｏｔ 1", "brot1") == 1 and quality.name_similarity("Brot", []) == 0


def test_receipt_that_was_not_read(spark):
    truth = spark.createDataFrame([(1, 980, "2020-01-02", None, "", 0), (2, None, "", "", None, 5)], "receipt_id long, total long, date string, time string, store string, tax long")
    known = spark.createDataFrame([(1, 0, 300), (1, 1, 680)], "receipt_id long, item_no long, price long")
    parsed = spark.createDataFrame([(2, 5, "matches", None, None, None, 5)], "receipt_id long, total long, check string, date string, time string, store string, tax long")
    none = spark.createDataFrame([], "receipt_id long, item_no long, kind string, total_minor long, unit_minor long")
    got = {r.measure: (r.right, r.total) for r in quality.quality_report(quality.receipt_scores(truth, known, parsed, none)).collect()}
    assert got == {"total right": (0, 1), "date right": (0, 1), "time right": (0, 0), "store right": (0, 0), "tax right": (1, 1), "items add up": (1, 2), "items found": (0, 2), "items right": (0, 0), "total not found": (1, None), "items missed": (1, None)}
