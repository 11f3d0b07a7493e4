"""Words of rows that may be long: each row is looked at once, not once for each of its words."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import receipt_marks as marks
from ledgerloom.functions import receipt_text as rt
from ledgerloom.operators import receipt_items as ri
from ledgerloom.operators import receipt_quality as quality
from ledgerloom.plans import all_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_votes_of_long_rows(spark):
    long = "wort ABC " * 20_000
    texts = [
        [long + "7 GBP"], ["EUR"], ["EUR x"], ["xEUR 5", "EURX 5", "ÄEUR 5"], ["Euro, yen, YEN", None], ["euroſ und EUROS"], ["3 TOP CHF CHF-USD"], ["", " ", None], [" 　USD\t"], ["aeuro yens", "\U0001d400EUR 5"], ["EUR5", "5KWD,KWD"],
    ]
    rows = spark.createDataFrame([(i, t) for i, ts in enumerate(texts) for t in ts], "receipt_id int, text string")
    codes = spark.createDataFrame([("CHF",), ("EUR",), ("USD",), ("KWD",)], "code string")
    got = rt.currencies(rows, codes)
    assert {r.receipt_id: r.currency for r in got.collect()} == {0: "GBP", 1: "EUR", 2: None, 3: None, 4: "JPY", 5: "EUR", 6: "CHF", 7: None, 8: "USD", 9: None, 10: "KWD"}
    # whether a word stands alone is asked of the row, not of each word with all of the row
    assert not re.search(r"size\(regexp_extract_all\(text", plan(got))


def test_languages_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "Zwischensumme  Sous-Total"), (1, "danke 5"), (2, "merci-total sous-total"), (3, None), (4, "ありがとう AB"), (5, "summe tax"), (6, "감사"), (7, "\U0001d400\U0001d401")], "receipt_id int, text string")
    assert {r.receipt_id: r.language for r in rt.languages(rows).collect()} == {1: "de", 2: "fr", 3: None, 4: "ja", 5: None, 6: "ko", 7: None}


def test_keywords_of_odd_rows(spark):
    said = [("E Summe", "total"), ("* E. SUMME 5", None), ("E. SUMME 5", "total"), ("1 zu  zahlen", "total"), ("　Zw. Summe", "subtotal"), ("İ Summe", None), ("Brot Summe", None), ("小 1,00円 計", "subtotal"), ("小 円 計", None), ("言 十 ¥5", "total"), ("点数 3 合計", None), ("3点 合計", None), ("3点 合計 ¥9", "total"), ("x点 合計", "total"), ("mit nanaco", "payment"), ("", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    got = df.select("i", marks.row_keyword(F.col("t")).alias("k"))
    assert [r.k for r in got.orderBy("i").collect()] == [k for _, k in said]
    # no walk over all words of a row
    assert "exists(" not in plan(got)


def test_words_are_not_worked_out_again_for_a_filter(spark):
    rows = spark.createDataFrame([(1, 1, "1,00- 2,00- A 3,00 A"), (1, 2, ""), (2, 1, None), (3, 1, "Brot")], "receipt_id long, row_no int, text string")
    got = marks.context(rows)
    assert not re.search("Filter .*regexp_extract_all", plan(got))
    assert {(r.receipt_id, r.trailing_minus_negates, r.tax_classes) for r in got.collect()} == {(1, False, "A"), (3, True, "")}


@pytest.mark.parametrize("name", ["RC12_misread_price", "RC12_above_date"])
def test_lines_are_gathered_once_for_repairs(spark, name):
    said = plan(all_queries()[0][name](spark, "/root/testdata/sf0.001"))
    assert said.count("Window [") == 1 and not re.search(r"Filter .*lambdafunction", said)


def test_prices_are_read_where_something_is_missing(spark):
    item = "array<struct<rows:array<int>,counts:int,text:string,quantity:decimal(18,9),unit:bigint,total:bigint,tax:boolean,kind:string,attached:boolean>>"
    x = lambda n, t: ([n], None, "Brot", Decimal(1), t, t, False, "article", False)
    row = (2, "Tee 1,020", "other")
    df = spark.createDataFrame([(1, [row], [x(1, 5)], 107), (2, [row], [x(1, 5), x(3, 7)], 114), (3, [row], [x(1, 5)], 5), (4, [row], [x(1, 5)], None), (5, [row, (3, "Eis 1,020", "other")], [x(1, 5)], 107)], f"id int, printed array<struct<row_no:int,text:string,kind:string>>, items {item}, due long")
    got = df.select("id", F.transform(ri.recovered_prices(F.col("printed"), F.col("items"), F.col("due"), F.lit(ri.NEVER), "EUR", 2), lambda i: i["total"]).alias("t"))
    assert {r.id: r.t for r in got.collect()} == {1: [5, 102], 2: [5, 102, 7], 3: [5], 4: [5], 5: [5]}


def test_a_report_reads_the_scores_once(spark):
    truth = spark.createDataFrame([(1, 5, "", "", "", 0), (2, 5, "", "", "", 0), (3, None, None, None, None, None)], "receipt_id long, total long, date string, time string, store string, tax long")
    parsed = truth.where("receipt_id <> 2").selectExpr("receipt_id", "total + 1 as total", "'matches' as check", "date", "time", "store", "tax")
    known = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, None), (2, 1, 10)], "receipt_id long, item_no long, price long")
    read = spark.createDataFrame([(1, 1, "article", 7, 10), (1, 2, "article", 10, None), (1, 3, "article", None, None), (3, 1, "article", 1, 1)], "receipt_id long, item_no long, kind string, total_minor long, unit_minor long")
    got = quality.quality_report(quality.receipt_scores(truth, known, parsed, read))
    assert plan(got).count("MapInArrow") == 1
    rows = {r.measure: (r.right, r.total) for r in got.collect()}
    assert rows == {"total right": (0, 2), "date right": (0, 0), "time right": (0, 0), "store right": (0, 0), "tax right": (0, 0), "items add up": (2, 3), "items found": (3, 4), "items right": (3, 4), "total not found": (1, None), "total wrong": (1, None), "items missed": (1, None), "extra items": (1, None)}
