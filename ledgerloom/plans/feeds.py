"""Queries: feeds that are written and read back, streams over them, joins within ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cash, fx
from ..sources import readers, writers
from ..streaming import jobs
from .core import BASED
from .ledger import EXCHANGE, _exchange
from .registry import query
from .text import FRAGMENT, _fragment
from .views import Views

DECIMAL = "rate::DECIMAL(38,18) AS rate"


@query("SRC2_rate_rows", f"SELECT quote, rate_date, {DECIMAL} FROM exchange_rate", "exchange_rate")
def src2(v: Views) -> DataFrame:
    """One array a month and file."""
    path = writers.shared_path(v.table("region").sparkSession, "rate-rows")
    rows = v.exchange_rate.groupBy(F.date_trunc("month", "rate_date")).agg(F.to_json(F.collect_list(F.struct(F.col("rate_date").alias("date"), "base", "quote", "rate"))).alias("value"))
    rows.select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = readers.rate_rows(v.table("region").sparkSession, path)
    return got.select("quote", F.to_date("date").alias("rate_date"), "rate")


@query("SRC5_fragments_tsv", 'SELECT "left", top, "right", bottom, text, count(*) AS n FROM fragment GROUP BY ALL', "line_item", FRAGMENT)
def src5(v: Views) -> DataFrame:
    spark = v.table("region").sparkSession
    path = writers.shared_path(spark, "fragments")
    boxes = ("left", "top", "right", "bottom")
    _fragment(v).select(F.concat_ws("\t", *boxes, "text").alias("value")).write.text(path)
    return readers.fragments_tsv(spark, path).groupBy(*boxes, "text").agg(F.count("*").alias("n"))


@query("SRC7_truth", "SELECT c_mktsegment AS currency, count(*)::VARCHAR AS total, min(c_name) AS store, count(*) AS n_items FROM customer GROUP BY 1")
def src7(v: Views) -> DataFrame:
    """One truth file for each market segment."""
    spark = v.table("region").sparkSession
    path = writers.shared_path(spark, "truth")
    per = v.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_name").alias("store"), F.array_join(F.transform(F.sort_array(F.collect_list("c_name")), lambda c: F.concat(F.lit("item\t"), c, F.lit("\t100"))), "\n").alias("items"))
    per.select(F.concat(F.lit("currency\t"), "c_mktsegment", F.lit("\ntotal\t"), F.col("n").cast("string"), F.lit("\nstore\t"), "store", F.lit("\n"), "items").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    renamed = readers.truth_text(spark.read.text(path).select(F.col("_metadata.file_path").alias("receipt_id"), "value", F.monotonically_increasing_id().alias("at")))
    return renamed.select("currency", "total", "store", F.size("items").cast("bigint").alias("n_items"))


@query("SRC8_records", "SELECT expense_id AS id, 1 + (expense_id % 3)::INTEGER AS words, total_minor::VARCHAR AS total, currency, occurred_date::DATE AS date FROM expense", "expense")
def src8(v: Views) -> DataFrame:
    word = F.struct(F.lit("w").alias("text"), *[F.lit(x).cast("double").alias(n) for x, n in enumerate(("x0", "y0", "x1", "y1"))])
    fields = F.struct(F.lit("shop").alias("merchant"), F.date_format("occurred_date", "yyyy-MM-dd").alias("date"), "currency", F.concat(F.lit("¥ "), F.col("total_minor").cast("string")).alias("total"))
    records = v.expense.select(F.col("expense_id").alias("id"), F.to_json(F.array_repeat(word, (1 + F.col("expense_id") % 3).cast("int"))).alias("words"), F.to_json(fields).alias("fields"))
    return readers.dataset_records(records)


@query("SNK1_archive", f"SELECT base, quote, rate_date, {DECIMAL}, f.f::BIGINT AS fetched_at, 'main' AS source FROM (SELECT DISTINCT base, quote, rate_date, rate FROM exchange_rate WHERE id LIKE '%-0') r, (VALUES (1000), (2000)) AS f(f)", "exchange_rate")
def snk1(v: Views) -> DataFrame:
    """Two fetches of the same rates; both stay."""
    spark = v.table("region").sparkSession
    path = writers.shared_path(spark, "archive")
    rates = v.exchange_rate.where("id LIKE '%-0'").select("base", "quote", "rate_date", F.col("rate").cast("decimal(38,18)").alias("rate")).repartition("rate_date")
    for at in (1000, 2000):
        writers.archive_rates(rates, path, "main", at)
    return spark.read.parquet(path).select("base", "quote", "rate_date", "rate", "fetched_at", "source")


@query("ST1_rate_ingest", f"SELECT base, quote, rate_date, {DECIMAL}, fetched_at, source FROM exchange_rate", "exchange_rate")
def st1(v: Views) -> DataFrame:
    spark = v.table("region").sparkSession
    feed, path, at = (writers.shared_path(spark, n) for n in ("feed", "archive", "offsets"))
    kind = "date string, base string, quote string, rate string, fetched_at long, source string"
    rates = v.exchange_rate.select(F.col("rate_date").cast("string").alias("date"), "base", F.lower("quote").alias("quote"), F.col("rate").cast("string").alias("rate"), "fetched_at", "source")
    # half of the rows come again without a usable rate
    bad = rates.where("fetched_at % 2 = 0").withColumn("rate", F.lit("-1"))
    rates.unionByName(bad).write.json(feed)
    jobs.stream_rates(spark.readStream.schema(kind).json(feed), v.currency, path, at).awaitTermination()
    return spark.read.parquet(path).select("base", "quote", "rate_date", "rate", "fetched_at", "source")


@query("ST2_live_conversion", "SELECT expense_id, total_base_minor::BIGINT AS total_base_minor FROM based", "expense exchange_rate", BASED)
def st2(v: Views) -> DataFrame:
    spark = v.table("region").sparkSession
    feed, archive, out, at = (writers.shared_path(spark, n) for n in ("expenses", "rates", "converted", "offsets"))
    v.expense.select("expense_id", "currency", "total_minor", "occurred_date").write.json(feed)
    v.exchange_rate.write.parquet(archive)
    arriving = spark.readStream.schema("expense_id long, currency string, total_minor long, occurred_date date").json(feed)
    jobs.stream_convert(arriving, lambda: spark.read.parquet(archive), v.currency, out, at).awaitTermination()
    return spark.read.parquet(f"{out}/converted").select("expense_id", "total_base_minor")


@query("JN7_self_join", "SELECT a.exchange_id, a.amount_minor AS given, b.amount_minor AS received FROM side a JOIN side b ON a.exchange_id = b.exchange_id WHERE a.amount_minor < 0 AND b.amount_minor > 0 AND a.currency <> b.currency", "settlement", EXCHANGE)
def jn7(v: Views) -> DataFrame:
    sides = cash.exchange_sides(_exchange(v))
    a, b = sides.alias("a"), sides.alias("b")
    met = a.join(b, (F.col("a.fx_rate_id") == F.col("b.fx_rate_id")) & (F.col("a.currency") != F.col("b.currency")))
    return met.where("a.amount_minor < 0 AND b.amount_minor > 0").select("a.exchange_id", F.col("a.amount_minor").alias("given"), F.col("b.amount_minor").alias("received"))


@query("JN8_as_of", "SELECT e.expense_id, (SELECT max(r.rate_date) FROM exchange_rate r WHERE r.quote = 'USD' AND r.rate_date <= e.occurred_date) AS rate_date FROM expense e", "expense exchange_rate")
def jn8(v: Views) -> DataFrame:
    legs = fx.both_directions(v.exchange_rate)
    days = v.expense.select(F.lit("EUR").alias("from_cur"), F.lit("USD").alias("to_cur"), F.col("occurred_date").alias("day")).distinct()
    found = fx.rate_on(days, legs).select("day", "rate_date")
    return v.expense.join(found, F.col("occurred_date") == F.col("day"), "left").select("expense_id", "rate_date")


@query("JN12_shared_elements", "SELECT e.expense_id, list_has_any(p.people, s.people) AS met FROM (SELECT expense_id FROM expense) e JOIN (SELECT expense_id, list(person_id) AS people FROM expense_payment GROUP BY 1) p USING (expense_id) JOIN (SELECT expense_id, list(person_id) AS people FROM expense_share WHERE person_id > '00000005' GROUP BY 1) s USING (expense_id)", "expense expense_payment expense_share")
def jn12(v: Views) -> DataFrame:
    people = lambda df: df.groupBy("expense_id").agg(F.collect_list("person_id").alias("people"))
    p, s = people(v.expense_payment).alias("p"), people(v.expense_share.where("person_id > '00000005'")).alias("s")
    return p.join(s, "expense_id").select("expense_id", F.arrays_overlap("p.people", "s.people").alias("met"))


@query("WIN4_nearest_above", "SELECT expense_id, position, (SELECT max(b.position) FROM line_item b WHERE b.expense_id = a.expense_id AND b.position <= a.position AND NOT b.attached) AS nearest FROM line_item a", "line_item")
def win4(v: Views) -> DataFrame:
    w = Window.partitionBy("expense_id").orderBy("position")
    return v.line_item.select("expense_id", "position", F.last(F.when(~F.col("attached"), F.col("position")), ignorenulls=True).over(w).alias("nearest"))
