"""Queries: sources, sinks, receipt text, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import receipt_text as rt
from ..functions.money import amount_text, decimal_text
from ..operators import balances as bal
from ..operators import cash, fx
from ..operators import receipt_layout as layout
from ..operators import timeline as tl
from ..sources import readers, writers
from ..streaming import jobs
from .core import based, facts, group_balances
from .registry import query
from .views import Views


@query("SRC1_live_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def src1(v: Views) -> DataFrame:
    o = v.table("orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.lit(1)))
    return readers.live(o).select("o_orderkey", "o_totalprice")


@query("SRC3_rate_map", "SELECT quote, rate_date, rate::DECIMAL(38,18) AS rate FROM (SELECT quote, rate_date, rate, row_number() OVER (PARTITION BY quote, rate_date ORDER BY fetched_at DESC) AS n FROM exchange_rate) WHERE n = 1", "exchange_rate")
def src3(v: Views) -> DataFrame:
    daily = fx.newest_per_day(v.exchange_rate, by_source=False)
    docs = daily.groupBy(F.col("rate_date").cast("string").alias("date")).agg(F.map_from_entries(F.collect_list(F.struct(F.lower("quote"), F.col("rate")))).alias("eur")).select(F.to_json(F.struct("date", "eur")).alias("value"))
    return readers.rate_map(docs).select("quote", F.col("date").cast("date").alias("rate_date"), "rate")


@query("SRC4_clean_rates", "SELECT quote, rate_date, rate::DECIMAL(38,18) AS rate FROM exchange_rate WHERE quote <> 'KWD' AND source = 'main'", "exchange_rate")
def src4(v: Views) -> DataFrame:
    raw = v.exchange_rate.select(F.when(F.col("quote") == "KWD", "not a day").otherwise(F.col("rate_date").cast("string")).alias("date"), F.lower("base").alias("base"), F.concat(F.lit(" "), F.lower("quote")).alias("quote"), F.when(F.col("source") == "main", F.col("rate").cast("string")).otherwise("-1").alias("rate"))
    return fx.clean(raw, v.currency).select("quote", "rate_date", "rate")


@query("SRC6_ocr_json", "SELECT expense_id AS receipt_id, position - 1 AS idx, text FROM line_item", "line_item")
def src6(v: Views) -> DataFrame:
    one = F.struct("position", F.struct("text", F.array(*[F.lit(i) for i in range(4)]).alias("box"), F.lit(0.9).cast("float").alias("confidence")).alias("f"))
    docs = v.line_item.groupBy(F.col("expense_id").alias("receipt_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["f"]).alias("fragments"))).alias("ocr_boxes"))
    return readers.fragments_json(docs).select("receipt_id", F.col("idx").cast("bigint").alias("idx"), "text")


@query("SNK3_cells", """SELECT expense_id, position, CASE WHEN contains(c, ';') OR contains(c, '"') THEN '"' || replace(c, '"', '""') || '"' ELSE c END AS cell FROM (SELECT expense_id, position, CASE position % 4 WHEN 0 THEN '''=' || text WHEN 1 THEN text || ';x' WHEN 2 THEN 'a "' || text || '"' ELSE text END AS c FROM line_item)""", "line_item")
def snk3(v: Views) -> DataFrame:
    p = F.col("position") % 4
    text = F.when(p == 0, F.concat(F.lit("="), "text")).when(p == 1, F.concat("text", F.lit(";x"))).when(p == 2, F.concat(F.lit('a "'), "text", F.lit('"'))).otherwise(F.col("text"))
    return v.line_item.select("expense_id", "position", writers.quoted(writers.text_cell(text)).alias("cell"))


@query("SNK4_values", "SELECT expense_id, occurred_at[:10] || ' ' || occurred_at[12:16] AS at, CASE currency WHEN 'JPY' THEN total_minor::VARCHAR WHEN 'KWD' THEN (total_minor // 1000)::VARCHAR || ',' || lpad((total_minor % 1000)::VARCHAR, 3, '0') ELSE (total_minor // 100)::VARCHAR || ',' || lpad((total_minor % 100)::VARCHAR, 2, '0') END AS amount FROM expense", "expense")
def snk4(v: Views) -> DataFrame:
    e = v.expense.join(F.broadcast(v.currency.select(F.col("code").alias("currency"), "exponent")), "currency")
    return e.select("expense_id", writers.date_time(F.col("occurred_at")).alias("at"), amount_text(F.col("total_minor"), F.col("exponent"), ",").alias("amount"))


@query("SNK4_decimals", "SELECT expense_id, position, rtrim(rtrim((quantity / 4)::DECIMAL(12,6)::VARCHAR, '0'), '.') AS shown FROM line_item", "line_item")
def snk4_decimals(v: Views) -> DataFrame:
    return v.line_item.select("expense_id", "position", decimal_text((F.col("quantity") / 4).cast("decimal(12,6)")).alias("shown"))


@query("SNK6_file_name", "SELECT group_id, replace(name, '_', '_') || '_ 2024-01-01.csv' AS file FROM grp", "grp")
def snk6(v: Views) -> DataFrame:
    return v.grp.select("group_id", writers.file_name(F.concat(F.lit("."), F.col("name"), F.lit("/. ")), "2024-01-01").alias("file"))


@query("SNK2_group_csv")
def snk2(v: Views) -> DataFrame:
    paid, consumed, _ = facts(v)
    return writers.group_lines(based(v), v.line_item, consumed, paid, v.member)


@query("SNK5_settlement_report")
def snk5(v: Views) -> DataFrame:
    return writers.settlement_report(bal.group_totals(v.grp, based(v)), bal.simplified_debts(group_balances(v)))


def _rows(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("receipt_id"), F.explode(F.split("text", "\n")).alias("text"))


@query("RC4_price", "SELECT expense_id, total_minor AS minor FROM expense", "expense")
def rc4(v: Views) -> DataFrame:
    m, k = F.col("total_minor"), F.col("expense_id") % 6
    grouped = lambda t, mark: F.regexp_replace(t, r"(?<=\d)(?=(\d{3})+$)", mark)

    def printed(two: Column) -> Column:
        whole = F.concat(grouped(F.regexp_extract(two, r"^\d+", 0), "."), F.regexp_extract(two, ",.*", 0))
        return F.when(k == 0, two).when(k == 1, whole).when(k == 2, F.concat(F.lit("€"), whole)).when(k == 3, F.concat(two, F.lit("-A"))).when(k == 4, F.concat(two, F.lit("*B"))).otherwise(F.concat(two, F.lit("EUR")))

    three = F.when(k % 2 == 0, amount_text(m, F.lit(3), ",")).otherwise(F.concat(F.lit("KWD"), amount_text(m, F.lit(3), ".")))
    by = F.when(F.col("currency") == "JPY", rt.price(F.concat(F.lit("*¥"), grouped(m.cast("string"), ",")), 0)).when(F.col("currency") == "KWD", rt.price(three, 3))
    return v.expense.select("expense_id", by.otherwise(rt.price(rt.bound(amount_text(m, F.lit(2), ","), printed), 2)).alias("minor"))


@query("RC5_quantity", "SELECT expense_id, position, CASE WHEN position % 3 = 2 THEN NULL ELSE quantity::DECIMAL(18,9) END AS quantity FROM line_item", "line_item")
def rc5(v: Views) -> DataFrame:
    q = decimal_text(F.col("quantity"))
    text = F.when(F.col("position") % 3 == 0, F.concat(q, F.lit("kg"))).when(F.col("position") % 3 == 1, F.concat(F.regexp_replace(q, r"\.", ","), F.lit("St"))).otherwise(F.concat(q, F.lit(",,1")))
    return v.line_item.select("expense_id", "position", rt.quantity(text).alias("quantity"))


@query("RC13_item_kind", "SELECT expense_id, position, CASE WHEN position % 6 = 5 THEN 'tax' WHEN total_minor < 0 THEN 'discount' WHEN position % 2 = 0 AND NOT regexp_matches(lower(w), 'leergut|pfandrück|pfandruck|pfandbon|pfandgutschrift|gutschein|gutschrift|coupon|voucher|rabatt|nachlass|preisvorteil|discount') THEN 'deposit' ELSE 'article' END AS kind FROM (SELECT *, ['Voucher', 'Nachlass', 'Preisvorteil', 'Gutschein', 'Rabatt', 'Kasten', 'Flasche'][1 + expense_id % 7] AS w FROM line_item)", "line_item")
def rc13(v: Views) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("Voucher", "Nachlass", "Preisvorteil", "Gutschein", "Rabatt", "Kasten", "Flasche")]), (1 + F.col("expense_id") % 7).cast("int"))
    text = F.when(F.col("position") % 2 == 0, F.concat(F.lit("PFAND "), "text", F.lit(" "), word)).otherwise(F.concat("text", F.lit(" Pfand "), word))
    return v.line_item.select("expense_id", "position", rt.item_kind(text, F.col("total_minor"), F.col("position") % 6 == 5).alias("kind"))


@query("RC16_total_check", "SELECT e.expense_id AS receipt_id, CASE WHEN e.expense_id % 9 = 0 THEN 'no_total' WHEN e.total_minor = coalesce(s.t, 0) THEN 'matches' ELSE 'differs' END AS check, CASE WHEN e.expense_id % 9 <> 0 THEN e.total_minor - coalesce(s.t, 0) END::BIGINT AS off FROM expense e LEFT JOIN (SELECT expense_id, sum(total_minor) AS t FROM line_item GROUP BY 1) s USING (expense_id)", "expense line_item")
def rc16(v: Views) -> DataFrame:
    header = v.expense.select(F.col("expense_id").alias("receipt_id"), F.when(F.col("expense_id") % 9 != 0, F.col("total_minor")).alias("total"))
    return rt.total_check(v.line_item.withColumnRenamed("expense_id", "receipt_id"), header)


@query("RC17_vat_rate", "SELECT expense_id, CASE WHEN expense_id % 30 > 0 THEN (expense_id % 30)::DECIMAL(12,6) END AS rate FROM expense", "expense")
def rc17(v: Views) -> DataFrame:
    n = F.col("expense_id") % 30
    text = F.concat(F.lit("MwSt 0% 100 % A="), n.cast("string"), F.when(F.col("expense_id") % 2 == 0, ",00").otherwise(""), F.when(F.col("expense_id") % 3 == 0, " ").otherwise(""), F.lit("% 3,82"))
    return v.expense.select("expense_id", rt.vat_rate(text).alias("rate"))


@query("RC18_date", "SELECT expense_id, CASE WHEN year(d) >= 2000 THEN d END AS day FROM (SELECT expense_id, (occurred_date + 1500)::DATE AS d FROM expense)", "expense")
def rc18(v: Views) -> DataFrame:
    d, k = F.date_add("occurred_date", 1500), F.col("expense_id") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy/MM/dd")).when(k == 1, F.concat(F.lit("am "), F.date_format(d, "dd.MM.yyyy"), F.lit("17:01"))).when(k == 2, F.date_format(d, "yyyy'年'M'月'd'日'")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return v.expense.select("expense_id", rt.purchase_date(text, F.lit(False), F.lit(False)).alias("day"))


@query("RC19_time", "SELECT expense_id, CASE WHEN expense_id % 6 IN (2, 4, 5) THEN NULL ELSE occurred_at[12:16] END AS at FROM expense", "expense")
def rc19(v: Views) -> DataFrame:
    t, k = F.substring("occurred_at", 12, 5), F.col("expense_id") % 6
    # runs of three and five digits before the colon are no time
    odd = F.when(k == 4, F.concat(F.lit("No 1"), t)).when(k == 5, F.concat(F.lit("No 123"), t))
    text = F.coalesce(odd, F.when(k == 0, F.concat(t, F.lit(":33 Uhr"))).when(k == 1, F.concat(F.lit("01.02.2020"), t)).when(k == 3, F.concat(F.lit("01.02.20"), t)).otherwise(F.concat(F.lit("offen "), t, F.lit(" - 24:00"))))
    return v.expense.select("expense_id", rt.purchase_time(text).alias("at"))


@query("RC21_payment_kind", """SELECT receipt_id, CASE WHEN cash AND NOT card THEN 'cash' WHEN card AND NOT cash THEN 'card' END AS payment FROM (SELECT receipt_id, max(w IN ('bar', 'barzahlung', 'bargeld', 'gegeben', 'bargegeben', 'cash', 'espèces', 'especes', 'efectivo', 'contanti')) AS cash, max(w IN ('karte', 'kartenzahlung', 'ec', 'eckarte', 'eccash', 'girocard', 'kreditkarte', 'debitkarte', 'visa', 'mastercard', 'maestro', 'vpay', 'amex', 'card', 'credit', 'debit', 'carte', 'tarjeta', 'carta')) AS card FROM (SELECT o_orderkey AS receipt_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['bar', 'total'] WHEN 1 THEN ['visa', 'sum'] ELSE ['cash', 'ec'] END) AS w FROM orders) GROUP BY 1)""")
def rc21(v: Views) -> DataFrame:
    k = F.col("o_orderkey") % 3
    rows = v.table("orders").select(F.col("o_orderkey").alias("receipt_id"), F.explode(F.when(k == 0, F.array(F.lit("BAR: 20,00"), F.lit("Total"))).when(k == 1, F.array(F.lit("* VISA ****"), F.lit("Sum"))).otherwise(F.array(F.lit("Cash"), F.lit("EC 5,00")))).alias("text"))
    return rt.payment_kind(rows)


@query("RC22_currency")
def rc22(v: Views) -> DataFrame:
    return rt.currencies(_rows(v), v.currency)


@query("RC23_language")
def rc23(v: Views) -> DataFrame:
    return rt.languages(_rows(v))


@query("ST3_cash_balances", "SELECT person_id, currency, sum(amount_minor)::BIGINT AS balance FROM cash_movement GROUP BY 1, 2", "cash_movement")
def st3(v: Views) -> DataFrame:
    """Several micro-batches, a restart after the first file, balances as last written."""
    spark = v.table("region").sparkSession
    feed, out, at = (writers.shared_path(spark, n) for n in ("movements", "balances", "offsets"))
    moves = v.cash_movement.select("person_id", "currency", "amount_minor")
    for part in range(2):  # the second half comes when the stream has stopped
        moves.where(F.pmod(F.xxhash64("person_id", "currency", "amount_minor"), F.lit(2)) == part).write.mode("append").json(feed)
        arriving = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 64).json(feed)
        jobs.stream_balances_to(arriving, out, at).awaitTermination()
    return jobs.latest_balances(spark.read.parquet(out))


@query("ST4_refresh_due", "SELECT id, fetched_at IS NULL OR 86400000::BIGINT * 1500 - fetched_at >= CASE WHEN source = 'main' THEN 3600000 ELSE 86400000 END AS due FROM exchange_rate", "exchange_rate")
def st4(v: Views) -> DataFrame:
    return v.exchange_rate.select("id", jobs.refresh_due(F.col("fetched_at"), F.lit(86400000 * 1500), F.col("source") == "main").alias("due"))


FRAGMENT = "fragment AS (SELECT expense_id AS receipt_id, position AS idx, (position % 2) * 300 + position AS left, position * 30 + (position // 3) * 25 AS top, (position % 2) * 300 + 250 - position % 7 AS right, position * 30 + (position // 3) * 25 + 18 + position % 5 AS bottom, text || CASE WHEN position % 3 = 0 THEN '' ELSE ' 5' END AS text FROM line_item),\nheights AS (SELECT receipt_id, h FROM (SELECT receipt_id, bottom - top AS h, row_number() OVER (PARTITION BY receipt_id ORDER BY bottom - top, idx) AS r, count(*) OVER (PARTITION BY receipt_id) AS n FROM fragment) WHERE r = n // 2 + 1)"


def _fragment(v: Views) -> DataFrame:
    p, third = F.col("position"), F.floor(F.col("position") / 3)
    side, top = (p % 2) * 300, p * 30 + third * 25
    return v.line_item.select(F.col("expense_id").alias("receipt_id"), p.alias("idx"), (side + p).alias("left"), top.alias("top"), (side + 250 - p % 7).alias("right"), (top + 18 + p % 5).alias("bottom"), F.concat("text", F.when(p % 3 == 0, "").otherwise(" 5")).alias("text"))


@query("WIN7_blocks", "SELECT receipt_id, idx, sum(CASE WHEN above IS NULL OR 2 * (top - above) >= h THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY top, \"left\", idx)::BIGINT AS block FROM (SELECT f.*, h, max(bottom) OVER (PARTITION BY f.receipt_id ORDER BY top, \"left\", idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM fragment f JOIN heights t ON t.receipt_id = f.receipt_id)", "line_item", FRAGMENT)
def win7(v: Views) -> DataFrame:
    return layout.blocks(_fragment(v)).select("receipt_id", "idx", "block")


@query("RC2_price_column", "SELECT receipt_id, idx, (r - \"right\") * 8 < r - l AND (\"left\" - l) * 2 > r - l AND regexp_matches(text, '[0-9]') AS in_price_column FROM (SELECT *, min(\"left\") OVER (PARTITION BY receipt_id) AS l, max(\"right\") OVER (PARTITION BY receipt_id) AS r FROM fragment)", "line_item", FRAGMENT)
def rc2(v: Views) -> DataFrame:
    return layout.price_column(_fragment(v)).select("receipt_id", "idx", "in_price_column")


@query("RC25_turned_boxes", "SELECT receipt_id, idx, round(200 + greatest((\"left\" - 200) * c - (top - 500) * s, (\"left\" - 200) * c - (bottom - 500) * s, (\"right\" - 200) * c - (top - 500) * s, (\"right\" - 200) * c - (bottom - 500) * s), 3) AS x1 FROM (SELECT *, cos(radians(idx % 9 - 4)) AS c, sin(radians(idx % 9 - 4)) AS s FROM fragment)", "line_item", FRAGMENT)
def rc25(v: Views) -> DataFrame:
    f = _fragment(v).withColumn("skew_degrees", F.col("idx") % 9 - 4).withColumn("width", F.lit(400)).withColumn("height", F.lit(1000))
    return layout.turned_bounds(f).select("receipt_id", "idx", F.round("x1", 3).alias("x1"))


@query("RC14_attach", """SELECT receipt_id, item_no, may AND coalesce(head = 'article', false) AS attached FROM (SELECT *, last_value(CASE WHEN NOT may THEN kind END IGNORE NULLS) OVER (PARTITION BY receipt_id ORDER BY item_no) AS head FROM (
SELECT *, coalesce(first_row - lag(last_row) OVER (PARTITION BY receipt_id ORDER BY item_no) BETWEEN 1 AND 2, false) AND first_row < 15 AND kind IN ('deposit', 'discount') AS may FROM (SELECT expense_id AS receipt_id, position AS item_no, position * 2 + position // 4 AS first_row, position * 2 + position // 4 AS last_row, kind FROM line_item)))""", "line_item")
def rc14(v: Views) -> DataFrame:
    row = F.col("position") * 2 + F.floor(F.col("position") / 4)
    items = v.line_item.select(F.col("expense_id").alias("receipt_id"), F.col("position").alias("item_no"), row.alias("first_row"), row.alias("last_row"), F.lit(15).alias("first_sum"), "kind", "text")
    return layout.attach(items).select("receipt_id", "item_no", "attached")


@query("RC24_drafts", "SELECT expense_id AS receipt_id, position, CASE WHEN kind = 'discount' THEN -abs(total_minor) ELSE abs(total_minor) END AS total_minor, kind, attached FROM line_item", "line_item")
def rc24(v: Views) -> DataFrame:
    signed = F.when(F.col("kind") == "discount", -F.abs("total_minor")).otherwise(F.abs("total_minor"))
    return v.line_item.select(F.col("expense_id").alias("receipt_id"), "position", signed.alias("total_minor"), "kind", "attached")


@query("RC28_status", "SELECT doc_id AS receipt_id, CASE WHEN text <> '' AND doc_id % 3 = 0 THEN 'reviewed' WHEN text <> '' THEN 'analyzed' ELSE 'new' END AS status FROM documents")
def rc28(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").alias("receipt_id"), (F.coalesce("text", F.lit("")) != "").alias("has_text"), (F.col("doc_id") % 3 == 0).alias("seen"))
    return layout.status(d).select("receipt_id", "status")


@query("CASH4_withdrawals", "SELECT 'movement' AS part, person_id, currency, sum(amount_minor)::BIGINT AS total FROM cash_movement WHERE kind = 'withdrawal' GROUP BY 2, 3 UNION ALL SELECT 'rate', 'EUR', currency, count(*) FROM cash_movement WHERE kind = 'withdrawal' AND currency <> 'EUR' GROUP BY currency UNION ALL SELECT 'fee', person_id, 'EUR', sum(amount_minor // 50)::BIGINT FROM cash_movement WHERE kind = 'withdrawal' AND amount_minor // 50 > 0 GROUP BY person_id", "cash_movement")
def cash4(v: Views) -> DataFrame:
    w = v.cash_movement.where("kind = 'withdrawal'").select(F.col("id").alias("withdrawal_id"), "person_id", "currency", "amount_minor", F.lit("EUR").alias("charged_currency"), F.col("amount_minor").alias("charged_minor"), F.floor(F.col("amount_minor") / 50).alias("fee_minor"), F.lit("m1").alias("method_id"))
    moved, rates, fees = cash.withdrawals(w)
    a = moved.groupBy("person_id", "currency").agg(F.sum("amount_minor").alias("total")).select(F.lit("movement").alias("part"), "person_id", "currency", "total")
    b = rates.groupBy("base", "quote").agg(F.count("*").alias("total")).select(F.lit("rate").alias("part"), F.col("base").alias("person_id"), F.col("quote").alias("currency"), "total")
    c = fees.groupBy("payer", "currency").agg(F.sum("total_minor").alias("total")).select(F.lit("fee").alias("part"), F.col("payer").alias("person_id"), "currency", "total")
    return a.unionByName(b).unionByName(c)


@query("TL6_receipt_archive", "SELECT d.doc_id AS receipt_id, e.expense_id FROM documents d LEFT JOIN (SELECT expense_id % 500 AS receipt_id, arg_min(expense_id, (occurred_date, expense_id)) AS expense_id, arg_min(category_id, (occurred_date, expense_id)) AS t FROM expense WHERE category_id IS NOT NULL GROUP BY 1) e ON e.receipt_id = d.doc_id WHERE contains(lower(d.text), 'the') OR contains(lower(d.source), 'src1') OR contains(lower(e.t), 'the')", "expense")
def tl6(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("doc_id").alias("receipt_id"), F.col("source").alias("merchant"), F.col("text").alias("raw_text"))
    e = v.expense.where("category_id IS NOT NULL").select((F.col("expense_id") % 500).alias("receipt_id"), "expense_id", F.col("category_id").alias("title"), F.col("occurred_date").alias("created_at"))
    both = tl.receipt_archive(d, e, " THE ").unionByName(tl.receipt_archive(d, e, "src1"))
    return both.select("receipt_id", "expense_id").distinct()
