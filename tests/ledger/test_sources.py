"""Readers, writers and streams on small files."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from ledgerloom.operators import fx
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import jobs

CURRENCY = [("EUR", 2), ("USD", 2), ("JPY", 0)]


def currency(spark):
    return spark.createDataFrame(CURRENCY, "code string, exponent int")


def test_rate_feeds_keep_small_rates_exact(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"date":"2024-01-05","base":"EUR","quote":"USD","rate":1.0945},{"date":"2024-01-05","base":"EUR","quote":"jpy","rate":0.000013273049},{"date":"2024-02-30","base":"EUR","quote":"USD","rate":1},{"date":"2024-01-05","base":"EUR","quote":"XXX","rate":2},{"date":"2024-01-05","base":"EUR","quote":"EUR","rate":1}]')
    got = fx.clean(readers.rate_rows(spark, str(tmp_path / "a.json")), currency(spark)).orderBy("quote").collect()
    assert [(r.quote, str(r.rate.normalize())) for r in got] == [("JPY", "0.000013273049"), ("USD", "1.0945")]
    lines = spark.createDataFrame([('{"date":"2024-01-05","eur":{"usd":1.0945,"jpy":1.3273049E-5}}',)], "value string")
    assert {(r.quote, str(r.rate.normalize() + 0)) for r in readers.rate_map(lines).collect()} == {("USD", "1.0945"), ("JPY", "0.000013273049")}


def test_fragments_and_truth(spark, tmp_path):
    (tmp_path / "r1.tsv").write_text('# a comment\n1\t2\t3\t4\tBrot "frisch" 1,99\n5\t6\t7\t8\tSumme\n')
    got = readers.fragments_tsv(spark, str(tmp_path / "r1.tsv")).orderBy("left").collect()
    assert [(r.receipt_id, r.left, r.text) for r in got] == [("r1", 1, 'Brot "frisch" 1,99'), ("r1", 5, "Summe")]
    (tmp_path / "t.tsv").write_text("currency\tJPY\ntotal\t980\nitem\ttea\t300\nitem\trice\t680\n")
    t = readers.truth_tsv(spark, str(tmp_path / "t.tsv")).first()
    assert (t.currency, t.total, t["items"]) == ("JPY", "980", ["tea\t300", "rice\t680"])


def test_archive_appends_and_csv_ends_lines(spark, tmp_path):
    rates = spark.createDataFrame([("EUR", "USD", "1.1", "2024-01-05")], "base string, quote string, rate string, day string").select("base", "quote", F.col("rate").cast("decimal(38,18)").alias("rate"), F.to_date("day").alias("rate_date"))
    for at in (1000, 2000):
        writers.archive_rates(rates, str(tmp_path / "archive"), "main", at)
    back = spark.read.parquet(str(tmp_path / "archive"))
    assert back.count() == 2 and fx.newest_per_day(back).first().fetched_at == 2000
    expense = spark.createDataFrame([(1, 7, "2024-01-05T10:20:00+01:00", dt.date(2024, 1, 5), "=food", 1050)], "group_id int, expense_id int, occurred_at string, occurred_date date, category_id string, total_base_minor long")
    items = spark.createDataFrame([(7, 1, 'a "b"; c', 1050)], "expense_id int, position int, text string, total_minor long")
    part = spark.createDataFrame([(1, 7, "p1", 1050)], "group_id int, expense_id int, person_id string, base_minor long")
    member = spark.createDataFrame([(1, "p2", 0), (1, "p1", 1)], "group_id int, person_id string, idx int")
    lines = writers.group_lines(expense, items, part, part, member)
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["﻿type;date;category;total;p2 paid;p2 share;p1 paid;p1 share", "expense;2024-01-05 10:20;'=food;10,50;;;10,50;10,50", 'item;;"a ""b""; c";10,50']
    writers.write_group_csv(lines, str(tmp_path / "csv"))
    (name,) = glob.glob(str(tmp_path / "csv" / "group_id=1" / "*.txt"))
    raw = open(name, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbftype") and raw.count(b"\r\n") == 3


def test_streams_equal_batches(spark, tmp_path):
    kind = "date string, base string, quote string, rate string, fetched_at long, source string"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"date":"2024-01-05","base":"EUR","quote":"USD","rate":"1.1","fetched_at":5,"source":"main"}\n{"date":"bad","base":"EUR","quote":"USD","rate":"1","fetched_at":5,"source":"main"}\n')
    feed = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    jobs.stream_rates(feed, currency(spark), str(tmp_path / "archive"), str(tmp_path / "c1")).awaitTermination()
    archive = lambda: spark.read.parquet(str(tmp_path / "archive"))
    assert archive().count() == 1
    (tmp_path / "ex").mkdir()
    (tmp_path / "ex" / "1.json").write_text('{"expense_id":1,"currency":"USD","total_minor":1100,"occurred_date":"2024-01-06"}\n{"expense_id":2,"currency":"JPY","total_minor":5,"occurred_date":"2024-01-06"}\n')
    arriving = spark.readStream.schema("expense_id int, currency string, total_minor long, occurred_date date").json(str(tmp_path / "ex"))
    jobs.stream_convert(arriving, archive, currency(spark), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert [(r.expense_id, r.total_base_minor) for r in spark.read.parquet(str(tmp_path / "out" / "converted")).collect()] == [(1, 1000)]
    assert [r.rule for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect()] == ["no_rate"]
    (tmp_path / "mv").mkdir()
    (tmp_path / "mv" / "1.json").write_text('{"person_id":"a","currency":"EUR","amount_minor":5}\n{"person_id":"a","currency":"EUR","amount_minor":-2}\n')
    moves = spark.readStream.schema("person_id string, currency string, amount_minor long").json(str(tmp_path / "mv"))
    q = jobs.stream_cash_balances(moves).writeStream.outputMode("complete").format("memory").queryName("balances").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.person_id, r.balance) for r in spark.table("balances").collect()] == [("a", 3)]


def test_nothing_doubles_across_batches_and_restarts(spark, tmp_path):
    kind = "date string, base string, quote string, rate string, fetched_at long, source string"
    row = ("2024-05-01", "EUR", "usd", "1.08", 7, "main")
    path, at, feed = (str(tmp_path / n) for n in ("archive", "offsets", "feed"))
    for extra in (("2024-05-01", "EUR", "jpy", "160", 7, "main"), ("2024-05-02", "EUR", "usd", "1.09", 8, "main"), row):
        spark.createDataFrame([row, extra], kind).coalesce(1).write.mode("append").json(feed)
        jobs.stream_rates(spark.readStream.schema(kind).json(feed), currency(spark), path, at).awaitTermination()  # stops and starts again
    back = spark.read.parquet(path)
    assert back.count() == back.select("id").distinct().count() == 3
    rates = spark.createDataFrame([("EUR", "USD", dt.date(2024, 5, 1), 1)], "base string, quote string, rate_date date, rate int")
    for fetch in (1, 1, 2):
        writers.archive_rates(rates, str(tmp_path / "fetches"), "main", fetch)
    assert spark.read.parquet(str(tmp_path / "fetches")).count() == 2


def test_balances_go_on_after_a_restart(spark, tmp_path):
    feed, out, at = (str(tmp_path / n) for n in ("moves", "out", "offsets"))
    kind = "person_id string, currency string, amount_minor long"
    sums = {}
    for part in ([("a", "EUR", 5), ("b", "EUR", 7)], [("a", "EUR", -2), ("a", "USD", 1)], [("b", "EUR", 3)]):
        spark.createDataFrame(part, kind).write.mode("append").json(feed)
        jobs.stream_balances_to(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(feed), out, at).awaitTermination()
        for p, c, m in part:
            sums[p, c] = sums.get((p, c), 0) + m
        assert {(r.person_id, r.currency): r.balance for r in jobs.latest_balances(spark.read.parquet(out)).collect()} == sums
