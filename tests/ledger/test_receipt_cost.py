"""Work that rows of a receipt don't need is not done."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import receipt_lines, receipt_marks
from ledgerloom.functions import receipt_text as rt
from ledgerloom.functions.receipt_vat import vat_lines
from ledgerloom.operators import receipt_quality as quality


def test_tax_rows_are_read_once(spark):
    rows = spark.createDataFrame([(1, 1, "19 % MwSt 0,30 4,00"), (1, 2, "Netto ohne MwSt 0,31"), (1, 3, "Danke"), (1, 4, None)], "receipt_id long, row_no long, text string")
    totals = spark.createDataFrame([(1, 1000)], "receipt_id long, total long")
    found = vat_lines(rows, totals, totals.limit(0).withColumnRenamed("total", "amount"), 2)
    assert [(r.receipt_id, int(r.rate), r.amount) for r in found.collect()] == [(1, 19, 30)]
    assert not re.search("Filter .*税", found._jdf.queryExecution().optimizedPlan().toString())


def test_rows_are_compared_as_far_as_needed(monkeypatch):
    item = {"item_no": 1, "name": "Brot rund", "price": "1,99"}
    read = lambda lines: next(quality._score(iter([pa.RecordBatch.from_pylist([{"receipt_id": 1, "total": "", "lines": lines, "items": [item]}])]))).to_pylist()[0]["items_right"]
    asked = []
    monkeypatch.setattr(quality, "most_like", lambda lines, text: asked.append(text) or lines[0])
    assert read(["Brot rund 1,99 A", "Summe"]) == 1 and read(["Brot rund ?", "Summe"]) == 0 and not asked
    assert read(["1,99", "Brot rund 7"]) == 1 and asked == ["Brot rund 1,99"]
    assert quality.highest("", [""]) == 1 and quality.highest("a", []) == 0 and quality.highest("ab", ["b", "ab", "abc"]) == 1


def test_words_and_prices_of_odd_text(spark):
    texts = ["", "  ", "a b　 c\t1,99", " x ", None, "−1,99 ¥5 *3,00A 1.234,50- ab 12 ,5"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rt.words(F.col("t")).alias("w"), F.transform(rt.words(F.col("t")), lambda w: rt.price(w, 2)).alias("p")).collect()
    assert [r.w for r in got] == [[], [], ["a", "b", "c", "1,99"], ["x"], None, ["−1,99", "¥5", "*3,00A", "1.234,50-", "ab", "12", ",5"]]
    assert [r.p for r in got] == [[], [], [None, None, None, 199], [None], None, [-199, None, 300, 123450, None, None, None]]


def test_tokens_are_read_once_for_what_the_receipt_says(spark):
    """Classes and minuses of a receipt come with its rows, as :func:`marks.context` has them."""
    rows = [(1, 0, "Brot 1,99 A"), (1, 1, "A 2,00 B 3,00 X"), (1, 2, "KG 1,00 ST"), (1, 3, None), (1, 4, ""), (2, 0, "Milch 1,09- A"), (2, 1, "Tee 2,00- B"), (2, 2, "B"), (2, 3, "Saft 0,25- B"), (3, 0, "AB CD 1,00 CD"), (4, 0, "   "), (5, 0, "C 1,00- C 2,00"), (6, 0, "なし")]
    df = spark.createDataFrame(rows, "receipt_id long, row_no int, text string")
    said = receipt_lines.tokened(df, 2)
    got = {r.receipt_id: (r.negates, " ".join(sorted(r.classes))) for r in said.collect()}
    want = {r.receipt_id: (r.trailing_minus_negates, r.tax_classes) for r in receipt_marks.context(df.withColumn("text", F.coalesce("text", F.lit(""))), 2).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got == {k: want.get(k, (True, "")) for k in got}
    assert got[1] == (True, "A B") and got[2][0] is False
    amounts = {(r.receipt_id, r.row_no): [x.p for x in r.tok if x.p is not None] for r in said.collect()}
    assert amounts[2, 0] == [109] and amounts[5, 0] == [-100, 200] and amounts[1, 1] == [200, 300]
    assert "Join" not in receipt_lines.lines(df, "EUR", 2)._jdf.queryExecution().optimizedPlan().toString()
