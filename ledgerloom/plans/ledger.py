"""Queries: breakdowns, timelines, cash, joins, windows, order, sets, filters, validation,
translation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import breakdown as bd
from ..operators import cash, fx, translation
from ..operators import timeline as tl
from ..operators import validate as val
from ..operators.numbering import lines_by_bucket, lines_of_all
from .core import ALL_VIEWS, BASED, IN_BASE, RATE, SHARES, all_shares, based, legs, payments_in_base
from .registry import half_even_sql, query
from .views import Views

# ------------------------------------------------------------------ breakdowns
CATEGORY = BASED + ",\nslice AS (SELECT group_id, category_id, sum(total_base_minor)::BIGINT AS amount, count(*) AS n FROM based GROUP BY 1, 2),\nranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY amount DESC, category_id NULLS FIRST) AS rank, sum(amount) OVER (PARTITION BY group_id)::BIGINT AS total FROM slice)"


def by_category(v: Views) -> DataFrame:
    return bd.breakdown(based(v), ["group_id"], ["category_id"], "total_base_minor")


@query("AGG1_by_category", "SELECT * FROM ranked", ALL_VIEWS, CATEGORY)
def agg1(v: Views) -> DataFrame:
    return by_category(v)


METHOD = IN_BASE + ",\nslice AS (SELECT e.group_id, p.person_id, p.payment_method_id, sum(base_minor)::BIGINT AS amount, count(*) AS n FROM paid p JOIN expense e USING (expense_id) GROUP BY 1, 2, 3)"


def by_payment(v: Views) -> DataFrame:
    facts = payments_in_base(v).join(v.expense.select("expense_id", "group_id"), "expense_id")
    return bd.breakdown(facts, ["group_id"], ["person_id", "payment_method_id"], "base_minor")


@query("AGG2_by_payment", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY amount DESC, person_id, payment_method_id NULLS FIRST) AS rank, sum(amount) OVER (PARTITION BY group_id)::BIGINT AS total FROM slice", ALL_VIEWS, METHOD)
def agg2(v: Views) -> DataFrame:
    return by_payment(v)


KIND = "CASE payment_method_id WHEN 'm1' THEN 'card' WHEN 'm2' THEN 'cash' ELSE 'none' END"


@query("AGG3_by_kind", f"SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY amount DESC, kind) AS rank FROM (SELECT group_id, {KIND} AS kind, sum(amount)::BIGINT AS amount, sum(n)::BIGINT AS n FROM slice GROUP BY 1, 2)", ALL_VIEWS, METHOD)
def agg3(v: Views) -> DataFrame:
    kind = F.when(F.col("payment_method_id") == "m1", "card").when(F.col("payment_method_id") == "m2", "cash").otherwise("none")
    return bd.regroup(by_payment(v).drop("rank", "total"), ["group_id"], kind, "kind", F.col("kind"))


@query("AGG3_rollup", f"SELECT group_id, {KIND} AS kind, payment_method_id, sum(amount)::BIGINT AS amount FROM slice GROUP BY ROLLUP (1, 2, 3)", ALL_VIEWS, METHOD)
def agg3_rollup(v: Views) -> DataFrame:
    kind = F.when(F.col("payment_method_id") == "m1", "card").when(F.col("payment_method_id") == "m2", "cash").otherwise("none")
    return by_payment(v).withColumn("kind", kind).rollup("group_id", "kind", "payment_method_id").agg(F.sum("amount").alias("amount"))


@query("AGG4_part_of_total", "SELECT group_id, category_id, th, CASE WHEN th > 0 AND th < 10 THEN '< 1 %' ELSE ((th + 5) // 10)::VARCHAR || ' %' END AS shown FROM (SELECT *, (amount * 1000 // total)::BIGINT AS th FROM ranked)", ALL_VIEWS, CATEGORY)
def agg4(v: Views) -> DataFrame:
    df = by_category(v).withColumn("th", bd.part_of_total(F.col("amount"), F.col("total")))
    return df.select("group_id", "category_id", "th", bd.percent_text(F.col("th")).alias("shown"))


@query("AGG5_arcs", "SELECT group_id, category_id, coalesce(lag(stop) OVER (PARTITION BY group_id ORDER BY rank), 0) AS start, stop FROM (SELECT *, (sum(amount) OVER (PARTITION BY group_id ORDER BY rank) * 1000 // total)::BIGINT AS stop FROM ranked)", ALL_VIEWS, CATEGORY)
def agg5(v: Views) -> DataFrame:
    return bd.arcs(by_category(v), ["group_id"]).select("group_id", "category_id", "start", "stop")


@query("AGG6_method_totals", "SELECT payment_method_id, currency, sum(amount_minor)::BIGINT AS total FROM expense_payment JOIN expense USING (expense_id) GROUP BY 1, 2", "expense expense_payment")
def agg6(v: Views) -> DataFrame:
    return v.expense_payment.join(v.expense.select("expense_id", "currency"), "expense_id").groupBy("payment_method_id", "currency").agg(F.sum("amount_minor").alias("total"))


@query("AGG7_cash_balances", "SELECT person_id, currency, sum(amount_minor)::BIGINT AS balance FROM cash_movement GROUP BY 1, 2", "cash_movement")
def agg7(v: Views) -> DataFrame:
    return cash.cash_balances(v.cash_movement)


@query("AGG8_day_totals", "SELECT group_id, occurred_date, sum(total_base_minor)::BIGINT AS total, count(*) AS n FROM based GROUP BY 1, 2", ALL_VIEWS, BASED)
def agg8(v: Views) -> DataFrame:
    return based(v).groupBy("group_id", "occurred_date").agg(F.sum("total_base_minor").alias("total"), F.count("*").alias("n"))


@query("AGG9_expense_count", "SELECT group_id, count(*) AS n FROM expense GROUP BY 1", "expense")
def agg9(v: Views) -> DataFrame:
    return v.expense.groupBy("group_id").agg(F.count("*").alias("n"))


@query("AGG10_confidence", "SELECT expense_id, min(q) AS low, avg(q)::DOUBLE AS mean, sum(CASE WHEN q < 0.9 THEN 1 ELSE 0 END)::BIGINT AS unsure FROM (SELECT expense_id, (1 - (position * 7 % 40) / 100.0)::DOUBLE AS q FROM line_item) GROUP BY 1", "line_item")
def agg10(v: Views) -> DataFrame:
    q = v.line_item.select("expense_id", (1 - (F.col("position") * 7 % 40) / 100.0).alias("q"))
    return q.groupBy("expense_id").agg(F.min("q").alias("low"), F.avg("q").alias("mean"), F.sum(F.when(F.col("q") < 0.9, 1).otherwise(0)).alias("unsure"))


@query("AGG11_unique_winner", "SELECT group_id, CASE WHEN count(*) = 1 THEN min(currency) END AS currency FROM (SELECT group_id, currency, dense_rank() OVER (PARTITION BY group_id ORDER BY n DESC) AS d FROM (SELECT group_id, currency, count(*) AS n FROM expense GROUP BY 1, 2)) WHERE d = 1 GROUP BY 1", "expense")
def agg11(v: Views) -> DataFrame:
    return bd.unique_winner(v.expense.groupBy("group_id", "currency").agg(F.count("*").alias("n")), ["group_id"], "currency", "n")


@query("AGG12_least_used_color", "SELECT color FROM (SELECT c_mktsegment AS color, count(*) AS n FROM customer GROUP BY 1) ORDER BY n, color LIMIT 1")
def agg12(v: Views) -> DataFrame:
    people = v.person
    palette = people.select("color").distinct().withColumn("place", F.col("color"))
    return bd.least_used(palette, people, "color")


@query("AGG13_distinct_parties", "SELECT expense_id, string_agg(DISTINCT person_id, ',' ORDER BY person_id) AS people, count(DISTINCT payment_method_id) AS methods FROM expense_payment GROUP BY 1", "expense expense_payment")
def agg13(v: Views) -> DataFrame:
    return v.expense_payment.groupBy("expense_id").agg(F.array_join(F.sort_array(F.collect_set("person_id")), ",").alias("people"), F.countDistinct("payment_method_id").alias("methods"))


@query("AGG14_named_parties", "SELECT s.expense_id, string_agg(p.name, ', ' ORDER BY p.name) AS names FROM (SELECT DISTINCT expense_id, person_id FROM shares) s JOIN person p USING (person_id) GROUP BY 1", ALL_VIEWS + " person", SHARES)
def agg14(v: Views) -> DataFrame:
    named = all_shares(v).select("expense_id", "person_id").distinct().join(v.person.select("person_id", "name"), "person_id")
    return named.groupBy("expense_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


# ------------------------------------------------------------------ timeline
TEXTS = "texts AS (SELECT expense_id, list(DISTINCT text) AS texts FROM line_item GROUP BY 1),\npeople AS (SELECT expense_id, list(DISTINCT person_id) AS people FROM (SELECT expense_id, person_id FROM expense_payment UNION ALL SELECT expense_id, person_id FROM participant) GROUP BY 1)"
ITEMS = TEXTS + """,
item AS (SELECT 'expense' AS item_type, e.expense_id AS item_id, e.group_id, e.occurred_at, e.category_id, p.people, coalesce(t.texts, []) AS texts, e.total_minor, e.currency FROM expense e JOIN people p USING (expense_id) LEFT JOIN texts t USING (expense_id)
  UNION ALL SELECT 'settlement', settlement_id, group_id, occurred_at, NULL, [from_person, to_person], [], amount_minor, currency FROM settlement),
items AS (SELECT *, occurred_at[:10]::DATE AS local_day, occurred_at[12:19] AS local_time FROM item)"""
TLV = "expense settlement line_item participant expense_payment"


def _items(v: Views) -> DataFrame:
    texts = v.line_item.groupBy("expense_id").agg(F.collect_set("text").alias("texts"))
    people = v.expense_payment.select("expense_id", "person_id").unionByName(v.participant.select("expense_id", "person_id")).groupBy("expense_id").agg(F.collect_set("person_id").alias("people"))
    e = v.expense.join(people, "expense_id").join(texts, "expense_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    return tl.timeline(e, v.settlement)


@query("TL1_timeline", "SELECT item_type, item_id, group_id, local_day, local_time, total_minor, len(people) AS people, len(texts) AS texts, row_number() OVER (PARTITION BY group_id ORDER BY local_day DESC, local_time DESC, item_type, item_id DESC) AS line FROM items", TLV, ITEMS)
def tl1(v: Views) -> DataFrame:
    return tl.ordered(_items(v), ["group_id"]).select("item_type", "item_id", "group_id", "local_day", "local_time", "total_minor", F.size("people").alias("people"), F.size("texts").alias("texts"), "line")


@query("SRT1_timeline_order", "SELECT group_id, string_agg(item_type[1] || item_id, ' ' ORDER BY line) AS top FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY local_day DESC, local_time DESC, item_type, item_id DESC) AS line FROM items) WHERE line <= 15 GROUP BY 1", TLV, ITEMS)
def srt1(v: Views) -> DataFrame:
    top = tl.ordered(_items(v), ["group_id"]).where("line <= 15")
    name = F.concat(F.substring("item_type", 1, 1), F.col("item_id").cast("string"))
    return top.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", name.alias("n")))), lambda x: x["n"]), " ").alias("top"))


@query("TL2_facets", "SELECT item_type, item_id FROM items WHERE list_has_any(people, ['00000003', '00000007', '00000011', '00000019']) AND local_day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", TLV, ITEMS)
def tl2(v: Views) -> DataFrame:
    keep = tl.facet_filter(people=["00000003", "00000007", "00000011", "00000019"], first="1996-01-01", last="1999-12-31")
    return _items(v).where(keep).select("item_type", "item_id")


@query("TL2_category_facet", "SELECT item_type, item_id FROM items WHERE item_type = 'expense' AND category_id IN ('1-URGENT', '2-HIGH')", TLV, ITEMS)
def tl2_category(v: Views) -> DataFrame:
    return _items(v).where(tl.facet_filter(categories=["1-URGENT", "2-HIGH"])).select("item_type", "item_id")


@query("TL3_search", "SELECT item_type, item_id FROM items WHERE len(list_filter(texts, lambda t: contains(lower(t), 'ring'))) > 0", TLV, ITEMS)
def tl3(v: Views) -> DataFrame:
    return _items(v).where(tl.text_search("  RING ")).select("item_type", "item_id")


@query("TL4_payers_text", "SELECT expense_id, string_agg(p.name || CASE WHEN m.name IS NOT NULL THEN ' (' || m.name || ')' ELSE '' END, ', ' ORDER BY x.person_id) AS payers FROM expense_payment x JOIN person p USING (person_id) LEFT JOIN method m ON m.method_id = x.payment_method_id GROUP BY 1", "expense expense_payment person method")
def tl4(v: Views) -> DataFrame:
    return tl.payers_text(v.expense_payment, v.person, v.method)


@query("TL5_day_heading", "SELECT expense_id, CASE occurred_date WHEN DATE '1998-10-03' THEN 'today' WHEN DATE '1998-10-02' THEN 'yesterday' ELSE dayname(occurred_date) || ' ' || occurred_date::VARCHAR END AS heading FROM expense", "expense")
def tl5(v: Views) -> DataFrame:
    return v.expense.select("expense_id", tl.day_heading(F.col("occurred_date"), F.lit("1998-10-03").cast("date")).alias("heading"))


@query("TL7_method_statement", "SELECT payment_method_id, expense_id, person_id, amount_minor, row_number() OVER (PARTITION BY payment_method_id ORDER BY occurred_at[:19]::TIMESTAMP - to_hours(occurred_at[22:22]::INT) DESC, expense_id DESC, person_id DESC) AS line FROM expense_payment JOIN expense USING (expense_id) WHERE payment_method_id IS NOT NULL", "expense expense_payment")
def tl7(v: Views) -> DataFrame:
    df = v.expense_payment.where("payment_method_id IS NOT NULL").join(v.expense.select("expense_id", tl.instant(F.col("occurred_at")).alias("at")), "expense_id")
    hour = -F.floor(F.unix_seconds("at") / 3600)
    df = df.select("payment_method_id", "expense_id", "person_id", "amount_minor", "at")
    return lines_by_bucket(df, ["payment_method_id"], hour, [F.desc("at"), F.desc("expense_id"), F.desc("person_id")]).drop("at")


@query("TOP1_latest_expenses", "SELECT expense_id, total_minor FROM expense ORDER BY occurred_date DESC, expense_id DESC LIMIT 10", "expense")
def top1(v: Views) -> DataFrame:
    return v.expense.orderBy(F.desc("occurred_date"), F.desc("expense_id")).limit(10).select("expense_id", "total_minor")


@query("TOP2_history_cap", "SELECT quote, count(*) AS lines FROM (SELECT quote, row_number() OVER (PARTITION BY quote ORDER BY rate_date DESC) AS n FROM rate) WHERE n <= 400 GROUP BY 1", "exchange_rate", RATE)
def top2(v: Views) -> DataFrame:
    daily = fx.newest_per_day(v.exchange_rate, by_source=False)
    return daily.withColumn("n", F.row_number().over(Window.partitionBy("quote").orderBy(F.desc("rate_date")))).where("n <= 400").groupBy("quote").agg(F.count("*").alias("lines"))


@query("TOP3_first_days", "SELECT item_type, item_id FROM (SELECT *, dense_rank() OVER (PARTITION BY group_id ORDER BY local_day DESC) AS d FROM items) WHERE d <= 20", TLV, ITEMS)
def top3(v: Views) -> DataFrame:
    return tl.first_days(_items(v), ["group_id"]).select("item_type", "item_id")


@query("TOP4_open_first", "SELECT doc_id, row_number() OVER (ORDER BY (expense_id IS NOT NULL), doc_id DESC) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS expense_id FROM documents)")
def top4(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("expense_id"))
    # a place in the whole archive: numbers per range, then a sum of the ranges before
    from pyspark.sql import Window as W

    key = F.when(F.col("expense_id").isNotNull(), 1).otherwise(0)
    b = d.withColumn("open", key).withColumn("block", -F.floor(F.col("doc_id") / 1000))
    per = b.groupBy("open", "block").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(W.orderBy("open", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    return b.join(per, ["open", "block"]).select("doc_id", (F.col("before") + F.row_number().over(W.partitionBy("open", "block").orderBy(F.desc("doc_id")))).alias("line"))


# ------------------------------------------------------------------ cash
@query("WIN5_running_balance", "SELECT id, sum(amount_minor) OVER (PARTITION BY person_id, currency ORDER BY occurred_ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS balance FROM cash_movement", "cash_movement")
def win5(v: Views) -> DataFrame:
    return cash.running_balance(v.cash_movement).select("id", "balance")


COUNT = "counts AS (SELECT id AS count_id, person_id, currency, abs(amount_minor) - 500 AS counted, occurred_ts FROM cash_movement WHERE id % 9 = 0)"


@query("WIN6_count_corrections", "SELECT c.count_id, sum(m.amount_minor)::BIGINT AS expected, nullif(max(c.counted) - sum(m.amount_minor), 0)::BIGINT AS correction FROM counts c JOIN cash_movement m ON m.person_id = c.person_id AND m.currency = c.currency AND m.occurred_ts <= c.occurred_ts WHERE c.counted >= 0 GROUP BY 1", "cash_movement", COUNT)
def win6(v: Views) -> DataFrame:
    m = v.cash_movement
    counts = m.where("id % 9 = 0").select(F.col("id").alias("count_id"), "person_id", "currency", (F.abs("amount_minor") - 500).alias("counted"), "occurred_ts")
    return cash.count_corrections(m, counts)


@query("CASH1_ledger", "SELECT person_id, currency, kind, count(*) AS n, sum(amount_minor)::BIGINT AS total FROM (SELECT person_id, currency, kind, amount_minor FROM cash_movement UNION ALL SELECT person_id, currency, 'payment', -amount_minor FROM expense_payment JOIN expense USING (expense_id) WHERE payment_method_id = 'm2') GROUP BY 1, 2, 3", "cash_movement expense expense_payment")
def cash1(v: Views) -> DataFrame:
    by_cash = v.expense_payment.join(v.method.where("kind = 'cash'").select(F.col("method_id").alias("payment_method_id")), "payment_method_id", "left_semi")
    paid = by_cash.join(v.expense.select("expense_id", "currency", tl.instant(F.col("occurred_at")).alias("occurred_ts")), "expense_id").withColumn("id", F.col("expense_id"))
    return cash.ledger(v.cash_movement, paid).groupBy("person_id", "currency", "kind").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total"))


EXCHANGE = "ex AS (SELECT settlement_id AS exchange_id, from_person AS person_id, 'EUR' AS given_currency, amount_minor AS given_minor, 'JPY' AS received_currency, amount_minor * 3 // 2 AS received_minor FROM settlement),\nside AS (SELECT exchange_id, person_id, given_currency AS currency, -given_minor AS amount_minor FROM ex UNION ALL SELECT exchange_id, person_id, received_currency, received_minor FROM ex)"


def _exchange(v: Views) -> DataFrame:
    return v.settlement.select(F.col("settlement_id").alias("exchange_id"), F.col("from_person").alias("person_id"), F.lit("EUR").alias("given_currency"), F.col("amount_minor").alias("given_minor"), F.lit("JPY").alias("received_currency"), F.floor(F.col("amount_minor") * 3 / 2).alias("received_minor"))


@query("CASH2_counterpart", "SELECT a.exchange_id, a.currency, b.currency AS other_currency, abs(b.amount_minor) AS other_minor FROM side a JOIN side b ON a.exchange_id = b.exchange_id AND a.currency <> b.currency", "settlement", EXCHANGE)
def cash2(v: Views) -> DataFrame:
    return cash.counterpart(cash.exchange_sides(_exchange(v)))


@query("CASH3_exchange_sides", "SELECT * FROM side", "settlement", EXCHANGE)
def cash3(v: Views) -> DataFrame:
    return cash.exchange_sides(_exchange(v)).drop("fx_rate_id")


@query("CASH5_valuation", f"""SELECT person_id, coalesce(sum(v), 0)::BIGINT AS value, '' AS missing FROM (SELECT b.person_id, CASE WHEN b.currency = 'EUR' THEN b.balance ELSE sign(b.balance) * {half_even_sql("abs(b.balance)::HUGEINT * 10000000000 * CASE b.currency WHEN 'JPY' THEN 100 ELSE 1 END", "r.num * CASE b.currency WHEN 'KWD' THEN 10 ELSE 1 END")} END AS v
FROM (SELECT person_id, currency, sum(amount_minor)::BIGINT AS balance FROM cash_movement GROUP BY 1, 2) b LEFT JOIN (SELECT quote, arg_max((rate * 10000000000)::HUGEINT, (rate_date, fetched_at, id)) AS num FROM exchange_rate GROUP BY 1) r ON r.quote = b.currency) GROUP BY 1""", "cash_movement exchange_rate")
def cash5(v: Views) -> DataFrame:
    return cash.valuation(cash.cash_balances(v.cash_movement), fx.latest(legs(v)), v.currency, "EUR")


@query("CASH6_cascade", "SELECT exchange_id, currency FROM side WHERE exchange_id % 5 = 0", "settlement", EXCHANGE)
def cash6(v: Views) -> DataFrame:
    sides = cash.exchange_sides(_exchange(v))
    return cash.cascade(sides, sides.where("currency = 'EUR' AND exchange_id % 5 = 0").select("exchange_id", "currency")).select("exchange_id", "currency")


# ------------------------------------------------------------------ joins
@query("JN1_children", "SELECT e.split_mode, count(*) AS n FROM expense e JOIN expense_share s USING (expense_id) GROUP BY 1", "expense expense_share")
def jn1(v: Views) -> DataFrame:
    return v.expense.join(v.expense_share, "expense_id").groupBy("split_mode").agg(F.count("*").alias("n"))


@query("JN2_naming", "SELECT x.expense_id, x.person_id, m.name AS method FROM expense_payment x LEFT JOIN method m ON m.method_id = x.payment_method_id", "expense_payment method")
def jn2(v: Views) -> DataFrame:
    return v.expense_payment.join(v.method.select(F.col("method_id").alias("payment_method_id"), F.col("name").alias("method")), "payment_method_id", "left").select("expense_id", "person_id", "method")


@query("JN3_live_parent", "SELECT e.expense_id FROM expense e LEFT JOIN grp g ON g.group_id = CASE WHEN e.expense_id % 13 = 0 THEN NULL ELSE e.group_id END WHERE e.expense_id % 13 = 0 OR NOT g.archived", "expense grp")
def jn3(v: Views) -> DataFrame:
    e = v.expense.select("expense_id", F.when(F.col("expense_id") % 13 != 0, F.col("group_id")).alias("group_id"))
    return e.join(v.grp.select("group_id", "archived"), "group_id", "left").where("group_id IS NULL OR NOT archived").select("expense_id")


@query("JN4_semi", "SELECT m.group_id, m.person_id FROM member m WHERE EXISTS (SELECT 1 FROM person p WHERE p.person_id = m.person_id AND NOT p.deleted)", "member person")
def jn4(v: Views) -> DataFrame:
    return v.member.join(v.person.where("NOT deleted"), "person_id", "left_semi").select("group_id", "person_id")


@query("JN5_first_match", "SELECT group_id, min(expense_id) AS expense_id FROM expense GROUP BY 1", "expense")
def jn5(v: Views) -> DataFrame:
    w = Window.partitionBy("group_id").orderBy("expense_id")
    return v.expense.withColumn("n", F.row_number().over(w)).where("n = 1").select("group_id", "expense_id")


@query("JN6_tombstones", "SELECT expense_id, position FROM line_item WHERE expense_id IN (SELECT expense_id FROM expense WHERE placed = 'F')", "line_item expense")
def jn6(v: Views) -> DataFrame:
    return v.line_item.join(v.expense.where("placed = 'F'"), "expense_id", "left_semi").select("expense_id", "position")


@query("JN9_anti", "SELECT m.group_id, m.person_id FROM member m WHERE NOT EXISTS (SELECT 1 FROM expense e WHERE e.payer = m.person_id AND e.currency = 'KWD')", "member expense")
def jn9(v: Views) -> DataFrame:
    return v.member.join(v.expense.where("currency = 'KWD'").select(F.col("payer").alias("person_id")), "person_id", "left_anti").select("group_id", "person_id")


@query("JN10_full_outer", "SELECT coalesce(a.person_id, b.person_id) AS person_id, a.n AS paid_n, b.n AS cash_n FROM (SELECT payer AS person_id, count(*) AS n FROM expense GROUP BY 1) a FULL JOIN (SELECT person_id, count(*) AS n FROM cash_movement GROUP BY 1) b ON a.person_id = b.person_id", "expense cash_movement")
def jn10(v: Views) -> DataFrame:
    a = v.expense.groupBy(F.col("payer").alias("person_id")).agg(F.count("*").alias("paid_n"))
    return a.join(v.cash_movement.groupBy("person_id").agg(F.count("*").alias("cash_n")), "person_id", "full_outer")


@query("JN11_within_key", "SELECT s.expense_id, count(*) AS cells FROM expense_share s JOIN expense_payment p USING (expense_id) GROUP BY 1", "expense_share expense_payment")
def jn11(v: Views) -> DataFrame:
    return v.expense_share.join(v.expense_payment.select("expense_id", F.col("person_id").alias("payer")), "expense_id").groupBy("expense_id").agg(F.count("*").alias("cells"))


# ------------------------------------------------------------------ windows, order, sets
LAST = "last AS (SELECT person_id, arg_max(payment_method_id, expense_id) AS method FROM expense_payment x JOIN method m ON m.method_id = x.payment_method_id WHERE NOT m.archived GROUP BY 1)"


def _last_method(v: Views) -> DataFrame:
    live = v.expense_payment.join(v.method.where("NOT archived").select(F.col("method_id").alias("payment_method_id")), "payment_method_id", "left_semi")
    return live.groupBy("person_id").agg(F.max_by("payment_method_id", "expense_id").alias("method"))


@query("WIN1_last_method", "SELECT * FROM last", "expense_payment method", LAST)
def win1(v: Views) -> DataFrame:
    return _last_method(v)


@query("WIN2_default_method", "SELECT p.person_id, coalesce(l.method, CASE WHEN p.only_one THEN 'm1' END) AS method FROM (SELECT person_id, color = 'BUILDING' AS only_one FROM person) p LEFT JOIN last l USING (person_id)", "expense_payment method person", LAST)
def win2(v: Views) -> DataFrame:
    usable = v.person.select("person_id", F.when(F.col("color") == "BUILDING", F.array(F.lit("m1"))).otherwise(F.array(F.lit("m1"), F.lit("m2"))).alias("usable"))
    return usable.join(_last_method(v), "person_id", "left").select("person_id", F.coalesce("method", F.when(F.size("usable") == 1, F.col("usable")[0])).alias("method"))


@query("WIN3_method_for_payment", "SELECT x.expense_id, x.person_id, CASE WHEN x.payment_method_id = 'm2' THEN 'm2' WHEN l.method = 'm2' THEN l.method ELSE 'm2' END AS method FROM expense_payment x LEFT JOIN last l USING (person_id)", "expense_payment method", LAST)
def win3(v: Views) -> DataFrame:
    cash_first = F.lit("m2")
    df = v.expense_payment.join(_last_method(v).withColumnRenamed("method", "last"), "person_id", "left")
    return df.select("expense_id", "person_id", F.coalesce(F.when(F.col("payment_method_id") == "m2", F.col("payment_method_id")), F.when(F.col("last") == "m2", F.col("last")), cash_first).alias("method"))


@query("WIN8_recent", "SELECT payer, category_id, n FROM (SELECT payer, category_id, row_number() OVER (PARTITION BY payer ORDER BY last DESC) AS n FROM (SELECT payer, category_id, max(expense_id) AS last FROM expense WHERE category_id IS NOT NULL GROUP BY 1, 2)) WHERE n <= 5", "expense")
def win8(v: Views) -> DataFrame:
    last = v.expense.where("category_id IS NOT NULL").groupBy("payer", "category_id").agg(F.max("expense_id").alias("last"))
    return last.withColumn("n", F.row_number().over(Window.partitionBy("payer").orderBy(F.desc("last")))).where("n <= 5").drop("last")


@query("WIN9_upper_median", "SELECT expense_id, total_minor AS median FROM (SELECT *, row_number() OVER (PARTITION BY expense_id ORDER BY total_minor, position) AS r, count(*) OVER (PARTITION BY expense_id) AS n FROM line_item) WHERE r = n // 2 + 1", "line_item")
def win9(v: Views) -> DataFrame:
    w = Window.partitionBy("expense_id")
    df = v.line_item.withColumn("r", F.row_number().over(w.orderBy("total_minor", "position"))).withColumn("n", F.count("*").over(w))
    return df.where("r = n div 2 + 1").select("expense_id", F.col("total_minor").alias("median"))


@query("WIN10_nearest", "SELECT expense_id, arg_min(position, abs(position - 3) * 1000 + position) AS nearest FROM line_item WHERE kind = 'deposit' GROUP BY 1", "line_item")
def win10(v: Views) -> DataFrame:
    return v.line_item.where("kind = 'deposit'").groupBy("expense_id").agg(F.min_by("position", F.struct(F.abs(F.col("position") - 3), "position")).alias("nearest"))


@query("SRT2_cash_order", "SELECT id, row_number() OVER (PARTITION BY person_id ORDER BY occurred_ts DESC, id DESC) AS line FROM cash_movement", "cash_movement")
def srt2(v: Views) -> DataFrame:
    return v.cash_movement.select("id", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("occurred_ts"), F.desc("id"))).alias("line"))


@query("SRT3_statement_order", "SELECT expense_id, person_id, row_number() OVER (PARTITION BY person_id ORDER BY occurred_at[:19]::TIMESTAMP - to_hours(occurred_at[22:22]::INT) DESC, expense_id DESC) AS line FROM expense_payment JOIN expense USING (expense_id)", "expense expense_payment")
def srt3(v: Views) -> DataFrame:
    df = v.expense_payment.join(v.expense.select("expense_id", tl.instant(F.col("occurred_at")).alias("at")), "expense_id")
    return df.select("expense_id", "person_id", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("at"), F.desc("expense_id"))).alias("line"))


@query("SRT4_oldest_first", "SELECT expense_id, row_number() OVER (PARTITION BY group_id ORDER BY occurred_date, expense_id) AS line FROM expense", "expense")
def srt4(v: Views) -> DataFrame:
    return v.expense.select("expense_id", F.row_number().over(Window.partitionBy("group_id").orderBy("occurred_date", "expense_id")).alias("line"))


@query("SRT5_people", "SELECT m.person_id, row_number() OVER (PARTITION BY m.group_id ORDER BY p.is_me DESC, lower(p.name), m.person_id) AS line FROM member m JOIN person p USING (person_id)", "member person")
def srt5(v: Views) -> DataFrame:
    df = v.member.join(v.person, "person_id")
    return df.select("person_id", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("is_me"), F.lower("name"), "person_id")).alias("line"))


@query("SRT6_methods", "SELECT m.method_id, n.n AS uses, row_number() OVER (ORDER BY m.archived, m.name) AS line FROM method m LEFT JOIN (SELECT payment_method_id, count(*) AS n FROM expense_payment GROUP BY 1) n ON n.payment_method_id = m.method_id", "method expense_payment")
def srt6(v: Views) -> DataFrame:
    n = v.expense_payment.groupBy(F.col("payment_method_id").alias("method_id")).agg(F.count("*").alias("uses"))
    return lines_of_all(v.method.join(n, "method_id", "left"), [F.col("archived"), F.col("name"), F.col("method_id")]).select("method_id", "uses", "line")


@query("SRT7_groups", "SELECT group_id, row_number() OVER (ORDER BY group_id DESC) AS line FROM (SELECT DISTINCT group_id FROM expense)", "expense")
def srt7(v: Views) -> DataFrame:
    return lines_of_all(v.expense.select("group_id").distinct(), [F.desc("group_id")]).select("group_id", "line")


@query("SET1_union", "SELECT expense_id, person_id FROM expense_share UNION SELECT expense_id, person_id FROM line_item_assignment", "expense_share line_item_assignment")
def set1(v: Views) -> DataFrame:
    return v.expense_share.select("expense_id", "person_id").union(v.line_item_assignment.select("expense_id", "person_id")).distinct()


@query("SET2_union_all", "SELECT item_type, count(*) AS n, sum(total_minor)::BIGINT AS total FROM items GROUP BY 1", TLV, ITEMS)
def set2(v: Views) -> DataFrame:
    return _items(v).groupBy("item_type").agg(F.count("*").alias("n"), F.sum("total_minor").alias("total"))


@query("SET3_difference", "SELECT DISTINCT p_name || ' ' || p_partkey % 40 AS source_text FROM part EXCEPT SELECT source_text || ' ' || updated_at % 40 FROM translation WHERE from_user", "translation")
def set3(v: Views) -> DataFrame:
    name = lambda text, number: F.concat(text, F.lit(" "), (F.col(number) % 40).cast("string")).alias("source_text")
    return v.table("part").select(name("p_name", "p_partkey")).distinct().join(v.translation.where("from_user").select(name("source_text", "updated_at")).distinct(), "source_text", "left_anti")


@query("SET4_overlap", "SELECT item_type, item_id FROM items WHERE NOT list_has_any(people, ['00000001', '00000002'])", TLV, ITEMS)
def set4(v: Views) -> DataFrame:
    return _items(v).where(~F.arrays_overlap("people", F.array(F.lit("00000001"), F.lit("00000002")))).select("item_type", "item_id")


@query("SET5_toggle", "SELECT payer, string_agg(category_id, ',' ORDER BY category_id) AS favourites FROM (SELECT payer, category_id FROM expense WHERE category_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1", "expense")
def set5(v: Views) -> DataFrame:
    odd = v.expense.where("category_id IS NOT NULL").groupBy("payer", "category_id").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.groupBy("payer").agg(F.array_join(F.sort_array(F.collect_list("category_id")), ",").alias("favourites"))


# ------------------------------------------------------------------ filters
@query("FLT1_live", "SELECT person_id, name FROM person WHERE NOT deleted", "person")
def flt1(v: Views) -> DataFrame:
    return v.person.where("NOT deleted").select("person_id", "name")


@query("FLT2_active_methods", "SELECT x.person_id, count(*) AS n FROM expense_payment x JOIN method m ON m.method_id = x.payment_method_id WHERE NOT m.archived GROUP BY 1", "expense_payment method")
def flt2(v: Views) -> DataFrame:
    m = v.method.where("NOT archived").select(F.col("method_id").alias("payment_method_id"))
    return v.expense_payment.join(m, "payment_method_id", "left_semi").groupBy("person_id").agg(F.count("*").alias("n"))


@query("FLT3_unarchived", "SELECT e.expense_id FROM expense e JOIN grp g USING (group_id) WHERE NOT g.archived", "expense grp")
def flt3(v: Views) -> DataFrame:
    return v.expense.join(v.grp.where("NOT archived"), "group_id", "left_semi").select("expense_id")


@query("FLT4_live_members", "SELECT m.group_id, m.person_id FROM member m JOIN person p USING (person_id) WHERE NOT p.deleted AND m.idx % 10 <> 9", "member person")
def flt4(v: Views) -> DataFrame:
    return v.member.where("idx % 10 <> 9").join(v.person.where("NOT deleted"), "person_id", "left_semi").select("group_id", "person_id")


@query("FLT5_base_currency", "SELECT e.expense_id FROM expense e JOIN grp g ON g.group_id = e.group_id AND g.base_currency = e.currency", "expense grp")
def flt5(v: Views) -> DataFrame:
    return v.expense.join(v.grp.select("group_id", F.col("base_currency").alias("currency")), ["group_id", "currency"], "left_semi").select("expense_id")


@query("FLT6_open_receipts", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT expense_id * 2 FROM expense)", "expense")
def flt6(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id").join(v.expense.select((F.col("expense_id") * 2).alias("doc_id")), "doc_id", "left_anti")


@query("FLT7_withdrawal_cards", "SELECT m.method_id, count(x.expense_id) AS n FROM method m LEFT JOIN expense_payment x ON x.payment_method_id = m.method_id WHERE NOT m.archived AND m.kind <> 'cash' GROUP BY 1", "method expense_payment")
def flt7(v: Views) -> DataFrame:
    n = v.expense_payment.groupBy(F.col("payment_method_id").alias("method_id")).agg(F.count("*").alias("n"))
    return v.method.where("NOT archived AND kind <> 'cash'").join(n, "method_id", "left").select("method_id", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------------ validation
@query("VAL1_payments", "SELECT e.expense_id, CASE WHEN e.total_minor <= 0 THEN 'total' WHEN p.n IS NULL THEN 'no_payer' WHEN p.low <= 0 THEN 'payment' WHEN p.people < p.n THEN 'payer_twice' WHEN p.paid <> e.total_minor THEN 'sum' END AS rule FROM expense e LEFT JOIN (SELECT expense_id, count(*) AS n, count(DISTINCT person_id) AS people, min(a) AS low, sum(a) AS paid FROM (SELECT *, amount_minor - CASE WHEN expense_id % 10 = 3 THEN 1 WHEN expense_id % 10 = 4 THEN amount_minor ELSE 0 END AS a FROM expense_payment WHERE expense_id % 10 <> 5) GROUP BY 1) p USING (expense_id)", "expense expense_payment")
def val1(v: Views) -> DataFrame:
    off = F.when(F.col("expense_id") % 10 == 3, 1).when(F.col("expense_id") % 10 == 4, F.col("amount_minor")).otherwise(0)
    return val.payments(v.expense, v.expense_payment.where("expense_id % 10 <> 5").withColumn("amount_minor", F.col("amount_minor") - off))


@query("VAL2_splits", "SELECT e.expense_id, CASE WHEN s.n IS NULL THEN 'nobody' WHEN split_mode = 'exact' AND s.low < 0 THEN 'exact_negative' WHEN split_mode = 'percent' AND s.percent <> 100 THEN 'percent_sum' WHEN split_mode = 'exact' AND s.exact <> e.total_minor THEN 'exact_sum' WHEN split_mode = 'weights' AND s.lw < 0 THEN 'weight_negative' WHEN split_mode = 'weights' AND s.w = 0 THEN 'weights_zero' END AS rule FROM expense e LEFT JOIN (SELECT expense_id, count(*) AS n, min(amount_minor) AS low, sum(amount_minor) AS exact, sum(percent) AS percent, min(weight) AS lw, sum(weight) AS w FROM (SELECT expense_id, amount_minor + CASE WHEN expense_id % 7 = 1 THEN 1 ELSE 0 END AS amount_minor, percent + CASE WHEN expense_id % 7 = 2 THEN 1 ELSE 0 END AS percent, CASE WHEN expense_id % 7 = 3 THEN 0 ELSE weight END AS weight FROM expense_share WHERE expense_id % 17 <> 5) GROUP BY 1) s USING (expense_id)", "expense expense_share")
def val2(v: Views) -> DataFrame:
    m = F.col("expense_id") % 7
    s = v.expense_share.where("expense_id % 17 <> 5").withColumn("amount_minor", F.col("amount_minor") + F.when(m == 1, 1).otherwise(0)).withColumn("percent", F.col("percent") + F.when(m == 2, 1).otherwise(0)).withColumn("weight", F.when(m == 3, F.lit(0).cast("decimal(12,6)")).otherwise(F.col("weight")))
    return val.splits(v.expense, s)


@query("VAL3_occurred_at", "SELECT expense_id, expense_id % 4 <> 1 AND expense_id % 6 <> 2 AS good FROM expense", "expense")
def val3(v: Views) -> DataFrame:
    t = F.when(F.col("expense_id") % 4 == 1, F.concat(F.lit("1997-02-30"), F.substring("occurred_at", 11, 20))).when(F.col("expense_id") % 6 == 2, F.regexp_replace("occurred_at", r"\+0", "+24")).otherwise(F.col("occurred_at"))
    return v.expense.select("expense_id", val.valid_occurred_at(t).alias("good"))


@query("VAL4_period", "SELECT expense_id, expense_id % 5 <> 0 AS good FROM expense", "expense")
def val4(v: Views) -> DataFrame:
    d = F.col("occurred_date")
    end = F.when(F.col("expense_id") % 5 == 0, F.date_sub(d, 1).cast("string")).when(F.col("expense_id") % 5 == 1, F.lit("  ")).otherwise(F.date_add(d, 7).cast("string"))
    return v.expense.select("expense_id", val.valid_period(d.cast("string"), end).alias("good"))


@query("VAL5_settlements", "SELECT settlement_id, CASE WHEN from_person = to_person THEN 'same_person' WHEN amount_minor <= 0 THEN 'amount' WHEN currency <> 'EUR' THEN 'currency' END AS rule FROM settlement", "settlement")
def val5(v: Views) -> DataFrame:
    return val.settlements(v.settlement, v.grp)


@query("VAL6_line_items", "SELECT expense_id, position, CASE WHEN q <= 0 THEN 'quantity' WHEN CASE WHEN kind = 'discount' THEN t > 0 ELSE t < 0 END THEN 'sign' END AS rule FROM (SELECT expense_id, position, kind, quantity - CASE WHEN position % 5 = 4 THEN 30 ELSE 0 END AS q, CASE WHEN expense_id % 3 = 0 THEN -total_minor ELSE total_minor END AS t FROM line_item)", "line_item")
def val6(v: Views) -> DataFrame:
    q = (F.col("quantity") - F.when(F.col("position") % 5 == 4, 30).otherwise(0)).cast("decimal(14,6)")
    return val.line_items(v.line_item.withColumn("quantity", q).withColumn("total_minor", F.when(F.col("expense_id") % 3 == 0, -F.col("total_minor")).otherwise(F.col("total_minor"))))


@query("VAL7_strangers", "SELECT x.expense_id, x.person_id FROM expense_payment x JOIN expense e USING (expense_id) LEFT JOIN (SELECT * FROM member WHERE idx % 7 <> 6) m ON m.group_id = e.group_id AND m.person_id = x.person_id WHERE m.person_id IS NULL", "expense expense_payment member")
def val7(v: Views) -> DataFrame:
    return val.strangers(v.expense_payment, v.expense, v.member.where("idx % 7 <> 6"))


@query("VAL8_account_terms", "SELECT x.expense_id, x.person_id, CASE WHEN x.kind = 'cash' AND x.amount % 2 = 0 THEN 'cash_currency' WHEN x.kind <> 'card' AND x.amount % 3 <> 0 THEN 'fees_only_on_cards' WHEN x.amount % 3 - 1 < 0 AND x.kind = 'card' THEN 'fee' END AS rule FROM (SELECT expense_id, person_id, CASE payment_method_id WHEN 'm1' THEN 'card' WHEN 'm2' THEN 'cash' END AS kind, amount_minor AS amount FROM expense_payment WHERE payment_method_id IS NOT NULL) x", "expense_payment")
def val8(v: Views) -> DataFrame:
    kind = F.when(F.col("payment_method_id") == "m1", "card").when(F.col("payment_method_id") == "m2", "cash")
    fixed = F.when(kind == "card", F.col("amount_minor") % 3 - 1).otherwise(F.when(F.col("amount_minor") % 3 != 0, 1).otherwise(0))
    m = v.expense_payment.where("payment_method_id IS NOT NULL").select(F.struct("expense_id", "person_id").alias("method_id"), kind.alias("kind"), fixed.alias("fixed_minor"), F.when((kind == "cash") & (F.col("amount_minor") % 2 == 0), "EUR").alias("fixed_currency"), F.lit(0).alias("foreign_percent"))
    return val.account_terms(m).select("method_id.expense_id", "method_id.person_id", "rule")


@query("VAL9_card_digits", "SELECT expense_id, length(expense_id::VARCHAR) = 4 AS good FROM expense", "expense")
def val9(v: Views) -> DataFrame:
    return v.expense.select("expense_id", val.valid_digits(F.lit("card"), F.concat(F.lit(" "), F.col("expense_id").cast("string"))).alias("good"))


@query("VAL10_points", "SELECT expense_id, expense_id % 200 - 100 BETWEEN -90 AND 90 AND expense_id % 400 - 200 BETWEEN -180 AND 180 AS good FROM expense", "expense")
def val10(v: Views) -> DataFrame:
    return v.expense.select("expense_id", val.valid_point(F.col("expense_id") % 200 - 100, F.col("expense_id") % 400 - 200).alias("good"))


@query("VAL11_tidy", "SELECT expense_id, position, CASE WHEN position % 4 = 0 THEN NULL ELSE trim(text) END AS title FROM line_item", "line_item")
def val11(v: Views) -> DataFrame:
    return v.line_item.select("expense_id", "position", val.blank_to_null(F.when(F.col("position") % 4 == 0, "   ").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))).alias("title"))


@query("VAL12_paid_is_shared", "SELECT p.expense_id, p.paid - c.shared AS off FROM (SELECT expense_id, sum(base_minor)::BIGINT AS paid FROM paid GROUP BY 1) p JOIN (SELECT expense_id, sum(base_minor)::BIGINT AS shared FROM consumed GROUP BY 1) c USING (expense_id)", ALL_VIEWS, IN_BASE)
def val12(v: Views) -> DataFrame:
    from .core import shares_in_base

    paid = payments_in_base(v).groupBy("expense_id").agg(F.sum("base_minor").alias("paid"))
    shared = shares_in_base(v).groupBy("expense_id").agg(F.sum("base_minor").alias("shared"))
    return paid.join(shared, "expense_id").select("expense_id", (F.col("paid") - F.col("shared")).alias("off"))


@query("VAL13_stored_split", "SELECT s.expense_id, s.person_id FROM expense_share s JOIN expense e USING (expense_id) WHERE (e.expense_id % 8 = 1) AND e.split_mode IN ('weights', 'percent', 'exact')", "expense expense_share")
def val13(v: Views) -> DataFrame:
    broken = v.expense.withColumn("split_mode", F.when((F.col("expense_id") % 8 == 1) & F.col("split_mode").isin("weights", "percent", "exact"), "equal").otherwise(F.col("split_mode")))
    return val.stored_split(v.expense_share, broken)


@query("VAL14_own_rate", "SELECT expense_id, CASE WHEN currency = 'EUR' THEN 'needless' WHEN expense_id % 3 = 0 AND currency = 'USD' THEN 'as_typed' WHEN expense_id % 3 <> 0 AND currency = 'USD' THEN 'inverted' ELSE 'rejected' END AS use FROM expense", "expense")
def val14(v: Views) -> DataFrame:
    typed = F.col("expense_id") % 3 == 0
    df = v.expense.select("expense_id", "currency", F.lit("EUR").alias("base"), F.when(typed, "USD").otherwise("EUR").alias("rate_from"), F.when(typed, "EUR").otherwise("USD").alias("rate_to"))
    return val.own_rate(df).select("expense_id", "use")


# ------------------------------------------------------------------ translation memory
ASK = "ask AS (SELECT DISTINCT CASE WHEN l.position % 3 = 0 THEN 'de' WHEN l.position % 3 = 1 THEN 'fr' END AS source_lang, text AS source_text FROM line_item l)"


def _ask(v: Views) -> DataFrame:
    lang = F.when(F.col("position") % 3 == 0, "de").when(F.col("position") % 3 == 1, "fr")
    return v.line_item.select(lang.alias("source_lang"), F.lit("en").alias("target_lang"), F.col("text").alias("source_text")).distinct()


@query("TM1_lookup", "SELECT a.source_lang, a.source_text, coalesce(o.t, m.t) AS translated_text FROM ask a LEFT JOIN (SELECT source_text, arg_max(translated_text, updated_at) AS t FROM translation WHERE from_user GROUP BY 1) o USING (source_text) LEFT JOIN (SELECT source_lang, source_text, arg_max(translated_text, updated_at) AS t FROM translation WHERE NOT from_user GROUP BY 1, 2) m ON m.source_lang = a.source_lang AND m.source_text = a.source_text", "line_item translation", ASK)
def tm1(v: Views) -> DataFrame:
    return translation.lookup(_ask(v), v.translation).drop("target_lang")


@query("TM2_upsert", "SELECT source_lang, source_text, arg_max(translated_text, (from_user::INT * 1000000000 + updated_at)) AS translated_text, max(from_user::INT) = 1 AS from_user FROM translation GROUP BY 1, 2", "translation")
def tm2(v: Views) -> DataFrame:
    t = v.translation
    return translation.upsert(t.where("updated_at % 2 = 0"), t.where("updated_at % 2 = 1")).select("source_lang", "source_text", "translated_text", "from_user")


@query("TM3_missing", "SELECT DISTINCT a.source_lang, a.source_text FROM ask a WHERE a.source_lang IS NOT NULL AND a.source_text NOT IN (SELECT source_text FROM translation WHERE updated_at % 50 = 0)", "line_item translation", ASK)
def tm3(v: Views) -> DataFrame:
    return translation.missing(_ask(v), v.translation.where("updated_at % 50 = 0"), "en")


@query("TM4_corrections", "SELECT source_lang, source_text, CASE WHEN updated_at % 4 = 2 THEN 'better ' ELSE '' END || translated_text AS translated_text FROM translation WHERE updated_at % 4 = 2", "translation")
def tm4(v: Views) -> DataFrame:
    edited = F.when(F.col("updated_at") % 4 == 2, F.concat(F.lit(" better "), F.col("translated_text"))).when(F.col("updated_at") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("translated_text")))
    return translation.corrections(v.translation.withColumn("edited", edited), "en").select("source_lang", "source_text", "translated_text")


@query("TM5_gate", "SELECT event_id, m >= -0.6 AND l >= -1.0 AS strict, m >= -1.0 AND l >= -2.0 AS balanced FROM (SELECT event_id, (-(event_id % 150)) / 100.0::DOUBLE AS m, (-(event_id % 270)) / 100.0::DOUBLE AS l FROM events)")
def tm5(v: Views) -> DataFrame:
    m, low = -(F.col("event_id") % 150) / 100.0, -(F.col("event_id") % 270) / 100.0
    return v.table("events").select("event_id", translation.passes("strict", m, low).alias("strict"), translation.passes("balanced", m, low).alias("balanced"))
