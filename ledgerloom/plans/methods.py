"""Queries: payment methods and their owners, statements, categories, active groups, histories
of all pairs, dates of receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fx, methods
from ..operators import timeline as tl
from ..operators import validate as val
from ..operators.numbering import lines_of_all
from ..operators.receipt_layout import details
from .registry import half_even_sql, query
from .views import Views

VISIBLE = "visible AS (SELECT w.*, p.name AS owner_name, p.is_me FROM wallet w LEFT JOIN person p ON p.person_id = w.owner WHERE NOT w.deleted AND (w.owner IS NULL OR (p.person_id IS NOT NULL AND NOT p.deleted)))"


@query("FLT2_own_methods", "SELECT owner, method_id, name FROM visible WHERE owner IS NOT NULL AND NOT archived", "wallet person", VISIBLE)
def flt2_own(v: Views) -> DataFrame:
    return methods.own_methods(v.wallet, v.person)


@query("FLT7_usable_cards", "SELECT owner, method_id FROM visible WHERE NOT archived AND kind <> 'cash'", "wallet person", VISIBLE)
def flt7_cards(v: Views) -> DataFrame:
    return methods.withdrawal_cards(v.wallet, v.person)


def _choice(v: Views) -> DataFrame:
    k = F.col("id")
    number = (k * 7) % 150
    return v.withdrawal.select("id", "person_id", F.concat(F.lit("w"), F.lpad(number.cast("string"), 8, "0")).alias("method_id"))


@query("FLT7_card_fits", "SELECT c.id, coalesce(u.owner IS NULL AND u.method_id IS NOT NULL OR u.owner = c.person_id, false) AS fits FROM (SELECT id, person_id, 'w' || lpad(((id * 7) % 150)::VARCHAR, 8, '0') AS method_id FROM withdrawal) c LEFT JOIN (SELECT * FROM visible WHERE NOT archived AND kind <> 'cash') u USING (method_id)", "wallet person withdrawal", VISIBLE)
def flt7_fits(v: Views) -> DataFrame:
    return methods.fits_owner(_choice(v), methods.withdrawal_cards(v.wallet, v.person)).select("id", "fits")


@query("SRT6_all_methods", "SELECT method_id, row_number() OVER (ORDER BY owner IS NULL, NOT coalesce(is_me, false), lower(owner_name) NULLS FIRST, owner NULLS FIRST, archived, lower(name), method_id) AS line FROM visible", "wallet person", VISIBLE)
def srt6_all(v: Views) -> DataFrame:
    return methods.all_methods(v.wallet, v.person).select("method_id", "line")


@query("SRT7_categories", "SELECT category_id, row_number() OVER (ORDER BY sort_order, lower(name), category_id) AS line FROM category WHERE NOT deleted", "category")
def srt7_categories(v: Views) -> DataFrame:
    return lines_of_all(v.category.where("NOT deleted"), [F.col("sort_order"), F.lower("name"), F.col("category_id")]).select("category_id", "line")


@query("FLT1_hidden_defaults", "SELECT category_id, name FROM category WHERE deleted AND is_default", "category")
def flt1_hidden(v: Views) -> DataFrame:
    return v.category.where("deleted AND is_default").select("category_id", "name")


@query("FLT1_all_for_naming", "SELECT l_orderkey AS expense_id, l_linenumber AS line, l_partkey AS part, name FROM lineitem JOIN category ON category_id = l_partkey", "category")
def flt1_names(v: Views) -> DataFrame:
    """Names of deleted categories stay on what was filed under them."""
    return v.table("lineitem").select(F.col("l_orderkey").alias("expense_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).join(v.category.select(F.col("category_id").alias("part"), "name"), "part")


@query("FLT3_active_group", "SELECT s.person_id, g.group_id AS active FROM (SELECT person_id, CASE WHEN idx % 5 <> 4 THEN (group_id + idx) % 27 END AS chosen FROM member) s LEFT JOIN grp g ON g.group_id = s.chosen AND NOT g.archived AND g.group_id % 8 <> 6", "member grp")
def flt3_active(v: Views) -> DataFrame:
    """The chosen group, or NULL when it is archived, deleted, unknown or none is chosen."""
    chosen = v.member.select("person_id", F.when(F.col("idx") % 5 != 4, (F.col("group_id") + F.col("idx")) % 27).alias("chosen"))
    live = v.grp.where("NOT archived AND group_id % 8 <> 6").select(F.col("group_id").alias("chosen"), F.col("group_id").alias("active"))
    return chosen.join(live, "chosen", "left").select("person_id", "active")



@query("WIN3_method_by_kind", """SELECT w.expense_id, w.person_id, coalesce(CASE WHEN c.kind = w.payment AND (c.owner IS NULL OR c.owner = w.person_id) THEN c.method_id END, CASE WHEN l.kind = w.payment AND (l.owner IS NULL OR l.owner = w.person_id) THEN l.method_id END,
  (SELECT arg_min(method_id, lower(name) || ' ' || method_id) FROM usable u WHERE u.owner = w.person_id AND u.kind = w.payment), (SELECT arg_min(method_id, lower(name) || ' ' || method_id) FROM usable u WHERE u.owner IS NULL AND u.kind = w.payment)) AS method
FROM wanted w LEFT JOIN usable c ON c.method_id = w.current LEFT JOIN lasts x ON x.person_id = w.person_id LEFT JOIN usable l ON l.method_id = x.last""", "wallet person expense expense_payment", VISIBLE + """,
usable AS (SELECT method_id, kind, name, owner FROM visible WHERE NOT archived),
wanted AS (SELECT p.expense_id, p.person_id, CASE WHEN p.expense_id % 4 < 2 THEN 'cash' ELSE 'card' END AS payment, CASE WHEN p.expense_id % 3 > 0 THEN 'w' || lpad((p.person_id::BIGINT + p.expense_id % 5)::VARCHAR, 8, '0') END AS current FROM expense_payment p),
lasts AS (SELECT person_id, 'w' || lpad((max(expense_id) % 150)::VARCHAR, 8, '0') AS last FROM expense_payment GROUP BY 1)""")
def win3_kind(v: Views) -> DataFrame:
    p, k = v.expense_payment, F.col("expense_id")
    named = lambda number: F.concat(F.lit("w"), F.lpad(number.cast("string"), 8, "0"))
    wanted = p.select("expense_id", "person_id", F.when(k % 4 < 2, "cash").otherwise("card").alias("payment"), F.when(k % 3 > 0, named(F.col("person_id").cast("bigint") + k % 5)).alias("current"))
    last = p.groupBy("person_id").agg(named(F.max("expense_id") % 150).alias("last"))
    usable = methods.visible(v.wallet, v.person).where("NOT archived")
    return methods.method_for_payment(wanted, usable, last).select("expense_id", "person_id", "method")


_BACK = half_even_sql("abs(w.amount_minor)::HUGEINT * 10000000000 * CASE w.currency WHEN 'JPY' THEN 100 ELSE 1 END", "(r.rate * 10000000000)::HUGEINT * CASE w.currency WHEN 'KWD' THEN 10 ELSE 1 END")
_THERE = half_even_sql("abs(w.amount_minor)::HUGEINT * (r.rate * 10000000000)::HUGEINT", "10000000000")


@query("TL7_method_payments", f"""SELECT payment_method_id, source, source_id, person_id, amount_minor, currency, row_number() OVER (PARTITION BY payment_method_id ORDER BY paid_at DESC, source, source_id DESC, person_id DESC) AS line FROM (
SELECT payment_method_id, 'expense' AS source, expense_id AS source_id, person_id, amount_minor::BIGINT AS amount_minor, currency, occurred_at[:19]::TIMESTAMP - to_hours(occurred_at[22:22]::INT) AS paid_at FROM expense_payment JOIN expense USING (expense_id) WHERE payment_method_id IS NOT NULL
UNION ALL SELECT w.payment_method_id, 'withdrawal', w.id, w.person_id, CASE WHEN r.quote = w.currency THEN sign(w.amount_minor) * {_BACK} WHEN r.base = w.currency THEN sign(w.amount_minor) * {_THERE} ELSE w.amount_minor END::BIGINT,
  CASE WHEN r.quote = w.currency THEN r.base WHEN r.base = w.currency THEN r.quote ELSE w.currency END, w.occurred_ts FROM withdrawal w LEFT JOIN exchange_rate r ON r.id = w.fx_rate_id)""", "expense expense_payment withdrawal exchange_rate")
def tl7_payments(v: Views) -> DataFrame:
    paid = v.expense_payment.join(v.expense.select("expense_id", "currency", tl.instant(F.col("occurred_at")).alias("at")), "expense_id")
    cash = v.withdrawal.withColumn("at", F.col("occurred_ts").cast("timestamp"))
    return methods.statement(paid, cash, v.exchange_rate, v.currency).select("payment_method_id", "source", "source_id", "person_id", "amount_minor", "currency", "line")


#: The archive with manual rates, cross rows, and a pair of its own beside EUR.
MORE = """more AS (SELECT id, base, quote, rate_date, fetched_at, CASE WHEN quote = 'USD' AND day(rate_date) % 11 = 4 THEN 'manual' ELSE source END AS source FROM exchange_rate
UNION ALL SELECT 'x-' || id, 'JPY', 'GBP', rate_date, fetched_at, 'cross' FROM exchange_rate WHERE quote = 'JPY' AND day(rate_date) = 9
UNION ALL SELECT 'p-' || id, 'KWD', 'USD', rate_date, fetched_at, source FROM exchange_rate WHERE quote = 'KWD' AND day(rate_date) = 7)"""
PAIRS = MORE + """,
codes AS (SELECT code FROM currency WHERE selectable),
pairs AS (SELECT a.code AS f, b.code AS t FROM codes a JOIN codes b ON a.code <> b.code),
turned AS (SELECT base AS f, quote AS t, id, rate_date, fetched_at, source FROM more UNION ALL SELECT quote, base, id, rate_date, fetched_at, source FROM more),
prov AS (SELECT * FROM turned WHERE source NOT IN ('manual', 'cross')),
own AS (SELECT f, t, rate_date, max(fetched_at) AS fetched_at, source, arg_max(id, (fetched_at, id)) AS legs FROM prov GROUP BY f, t, rate_date, source UNION ALL SELECT f, t, rate_date, fetched_at, source, id FROM turned WHERE source IN ('manual', 'cross')),
leg AS (SELECT f, t, rate_date, max(fetched_at) AS fetched_at, arg_max(id, (fetched_at, id)) AS id, arg_max(source, (fetched_at, id)) AS source FROM prov WHERE f = 'EUR' OR t = 'EUR' GROUP BY f, t, rate_date),
need AS (SELECT * FROM pairs WHERE f <> 'EUR' AND t <> 'EUR' AND (f, t) NOT IN (SELECT (f, t) FROM prov)),
days AS (SELECT DISTINCT n.f, n.t, l.rate_date AS day FROM need n JOIN leg l ON (l.f = n.f AND l.t = 'EUR') OR (l.f = 'EUR' AND l.t = n.t)),
crossed AS (SELECT DISTINCT d.f, d.t, greatest(a.rate_date, b.rate_date) AS rate_date, least(a.fetched_at, b.fetched_at) AS fetched_at, CASE WHEN a.source = b.source THEN a.source ELSE a.source || ' + ' || b.source END AS source, a.id || '+' || b.id AS legs
  FROM days d ASOF JOIN (SELECT * FROM leg WHERE t = 'EUR') a ON a.f = d.f AND d.day >= a.rate_date ASOF JOIN (SELECT * FROM leg WHERE f = 'EUR') b ON b.t = d.t AND d.day >= b.rate_date)"""


@query("FXR7_all_pairs", "SELECT from_cur, to_cur, line, rate_date, fetched_at, source, legs FROM (SELECT f AS from_cur, t AS to_cur, rate_date, fetched_at, source, legs, row_number() OVER (PARTITION BY f, t ORDER BY rate_date DESC, fetched_at DESC, legs DESC) AS line FROM (SELECT * FROM own UNION ALL SELECT * FROM crossed) JOIN pairs USING (f, t)) WHERE line <= 400", "exchange_rate currency", PAIRS)
def fxr7_all(v: Views) -> DataFrame:
    r, day = v.exchange_rate, F.dayofmonth("rate_date")
    manual = r.withColumn("source", F.when((F.col("quote") == "USD") & (day % 11 == 4), "manual").otherwise(F.col("source")))
    cross = r.where((F.col("quote") == "JPY") & (day == 9)).withColumns({"id": F.concat(F.lit("x-"), "id"), "base": F.lit("JPY"), "quote": F.lit("GBP"), "source": F.lit("cross")})
    direct = r.where((F.col("quote") == "KWD") & (day == 7)).withColumns({"id": F.concat(F.lit("p-"), "id"), "base": F.lit("KWD"), "quote": F.lit("USD")})
    code = v.currency.where("selectable").select("code")
    pairs = code.toDF("from_cur").join(F.broadcast(code.toDF("to_cur")), F.col("from_cur") != F.col("to_cur"))  # a fixed dimension
    found = fx.histories(manual.unionByName(cross).unionByName(direct), pairs)
    return found.select("from_cur", "to_cur", "line", "rate_date", "fetched_at", "source", F.array_join("legs", "+").alias("legs"))


DATED = "SELECT expense_id, position, CASE WHEN (position + expense_id) % 4 = 3 AND expense_id % 6 <> 5 THEN DATE '2024-01-01' + position::INT END AS day, CASE WHEN (position * 3 + expense_id) % 5 < 2 THEN lpad((position % 24)::VARCHAR, 2, '0') || ':15' END AS time FROM line_item"


@query("WIN10_time_of_dated_row", "SELECT r.expense_id, f.day, arg_min(r.time, (abs(r.position - coalesce(f.at, 0)), r.position)) FILTER (WHERE r.time IS NOT NULL) AS time FROM rows r JOIN (SELECT expense_id, min(position) FILTER (WHERE day IS NOT NULL) AS at, arg_min(day, position) FILTER (WHERE day IS NOT NULL) AS day FROM rows GROUP BY 1) f USING (expense_id) GROUP BY 1, 2", "line_item", f"rows AS ({DATED})")
def win10_dated(v: Views) -> DataFrame:
    p, e = F.col("position"), F.col("expense_id")
    day = F.when(((p + e) % 4 == 3) & (e % 6 != 5), F.date_add(F.lit("2024-01-01").cast("date"), p.cast("int")))
    time = F.when((p * 3 + e) % 5 < 2, F.concat(F.lpad((p % 24).cast("string"), 2, "0"), F.lit(":15")))
    rows = v.line_item.select(e.alias("receipt_id"), p.alias("row"), day.alias("day"), time.alias("time"))
    return details(rows).withColumnRenamed("receipt_id", "expense_id")


@query("VAL7_foreign_participants", "SELECT x.expense_id, x.person_id FROM participant x JOIN expense e USING (expense_id) WHERE NOT EXISTS (SELECT 1 FROM member m JOIN person p USING (person_id) WHERE NOT p.deleted AND m.group_id = e.group_id AND m.person_id = x.person_id)", "participant expense member person")
def val7_participants(v: Views) -> DataFrame:
    live = v.member.join(v.person.where("NOT deleted").select("person_id"), "person_id", "left_semi")
    return val.strangers(v.participant, v.expense, live)


@query("VAL7_dead_methods", "SELECT x.expense_id, x.person_id, x.payment_method_id FROM expense_payment x WHERE payment_method_id IS NOT NULL AND payment_method_id NOT IN (SELECT method_id FROM method WHERE NOT archived AND kind <> 'cash')", "expense_payment method")
def val7_methods(v: Views) -> DataFrame:
    return val.missing_reference(v.expense_payment, v.method.where("NOT archived AND kind <> 'cash'"), "payment_method_id", "method_id").select("expense_id", "person_id", "payment_method_id")


@query("VAL7_dead_categories", "SELECT l_orderkey AS expense_id, l_linenumber AS line, l_partkey AS category_id FROM lineitem WHERE l_partkey NOT IN (SELECT category_id FROM category WHERE NOT deleted)", "category")
def val7_categories(v: Views) -> DataFrame:
    filed = v.table("lineitem").select(F.col("l_orderkey").alias("expense_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("category_id"))
    return val.missing_reference(filed, v.category.where("NOT deleted"), "category_id", "category_id").select("expense_id", "line", "category_id")


@query("VAL7_receipts_held_twice", "SELECT receipt_id, count(*) AS held FROM (SELECT CASE WHEN expense_id % 5 > 0 THEN expense_id // 3 * 3 + expense_id % 2 END AS receipt_id FROM expense WHERE placed <> 'P') WHERE receipt_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "expense")
def val7_receipts(v: Views) -> DataFrame:
    held = F.when(F.col("expense_id") % 5 > 0, F.expr("expense_id div 3 * 3 + expense_id % 2"))
    return val.receipts_held_twice(v.expense.where("placed <> 'P'").select("expense_id", held.alias("receipt_id")))
