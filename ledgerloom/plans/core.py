"""Queries: money, splits, rates, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..operators import balances as bal
from ..operators import fx, split
from .registry import allocate_sql, half_even_sql, query
from .views import Views

# ------------------------------------------------------------------ shared pieces in SQL
RATE = """
rate AS (SELECT * EXCLUDE (rn), lead(rate_date) OVER (PARTITION BY quote ORDER BY rate_date) AS valid_to, row_number() OVER (PARTITION BY quote ORDER BY rate_date) AS nth FROM (
  SELECT quote, rate_date, fetched_at, id, (rate * 10000000000)::HUGEINT AS num, row_number() OVER (PARTITION BY quote, rate_date ORDER BY fetched_at DESC, id DESC) AS rn FROM exchange_rate) WHERE rn = 1)"""
BASED = RATE + f""",
based AS (SELECT e.*, CASE WHEN e.currency = 'EUR' THEN e.total_minor ELSE sign(e.total_minor) * {half_even_sql(
    "abs(e.total_minor)::HUGEINT * 10000000000 * CASE e.currency WHEN 'JPY' THEN 100 ELSE 1 END", "coalesce(r.num, f.num) * CASE e.currency WHEN 'KWD' THEN 10 ELSE 1 END")} END AS total_base_minor
  FROM expense e LEFT JOIN rate r ON r.quote = e.currency AND e.occurred_date >= r.rate_date AND (r.valid_to IS NULL OR e.occurred_date < r.valid_to)
  LEFT JOIN rate f ON f.quote = e.currency AND f.nth = 1)"""
SHARES = f"""
plain AS ({allocate_sql("SELECT s.expense_id, s.person_id, e.total_minor AS total, CASE e.split_mode WHEN 'weights' THEN s.weight * 1000000 WHEN 'percent' THEN s.percent * 1000000 ELSE 1000000 END::HUGEINT AS w, e.split_mode, s.amount_minor FROM expense_share s JOIN expense e ON e.expense_id = s.expense_id WHERE e.split_mode <> 'items'", "expense_id", ", split_mode, amount_minor")}),
owned AS (SELECT *, coalesce(max(CASE WHEN NOT attached THEN position END) OVER (PARTITION BY expense_id ORDER BY position), min(position) OVER (PARTITION BY expense_id)) AS owner FROM line_item),
holders AS (SELECT expense_id, position, string_agg(person_id || ':' || weight::VARCHAR, ',' ORDER BY person_id) AS hk FROM line_item_assignment GROUP BY 1, 2),
everyone AS (SELECT expense_id, string_agg(person_id || ':' || weight::VARCHAR, ',' ORDER BY person_id) AS hk FROM participant GROUP BY 1),
pooled AS (SELECT o.expense_id, coalesce(h.hk, v.hk) AS hk, sum(o.total_minor) AS pool FROM owned o JOIN expense e ON e.expense_id = o.expense_id AND e.split_mode = 'items'
  LEFT JOIN holders h ON h.expense_id = o.expense_id AND h.position = o.owner JOIN everyone v ON v.expense_id = o.expense_id GROUP BY 1, 2),
hold AS (SELECT DISTINCT * FROM (SELECT h.expense_id, h.hk, a.person_id, a.weight FROM holders h JOIN line_item_assignment a ON a.expense_id = h.expense_id AND a.position = h.position
  UNION ALL SELECT v.expense_id, v.hk, p.person_id, p.weight FROM everyone v JOIN participant p ON p.expense_id = v.expense_id)),
parts AS ({allocate_sql("SELECT p.expense_id, p.hk, h.person_id, p.pool AS total, (h.weight * 1000000)::HUGEINT AS w FROM pooled p JOIN hold h ON h.expense_id = p.expense_id AND h.hk = p.hk", "expense_id, hk")}),
sofar AS (SELECT expense_id, person_id, sum(part) AS sofar, max(dw) AS dw FROM (SELECT expense_id, person_id, share AS part, NULL AS dw FROM parts
  UNION ALL SELECT p.expense_id, p.person_id, 0, p.weight FROM participant p JOIN expense e ON e.expense_id = p.expense_id AND e.split_mode = 'items') GROUP BY 1, 2),
rest AS ({allocate_sql("SELECT s.expense_id, s.person_id, s.sofar, e.total_minor - sum(s.sofar) OVER (PARTITION BY s.expense_id) AS total, CASE WHEN max(s.sofar) OVER (PARTITION BY s.expense_id) > 0 THEN greatest(s.sofar, 0) * 1000000 ELSE coalesce(s.dw, 0) * 1000000 END::HUGEINT AS w FROM sofar s JOIN expense e ON e.expense_id = s.expense_id", "expense_id", ", sofar")}),
shares AS (SELECT expense_id, person_id, CASE WHEN split_mode = 'exact' THEN amount_minor ELSE share END::BIGINT AS share_minor FROM plain
  UNION ALL SELECT expense_id, person_id, (sofar + coalesce(share, 0))::BIGINT FROM rest)"""


def _rescaled(table: str, amount: str, keys: str) -> str:
    inner = f"SELECT s.*, b.total_base_minor AS total, abs(s.{amount})::HUGEINT * 1000000 AS w, min(s.{amount}) OVER (PARTITION BY s.expense_id) < 0 AND max(s.{amount}) OVER (PARTITION BY s.expense_id) > 0 AS mixed FROM {table} s JOIN based b ON b.expense_id = s.expense_id"
    return f"SELECT expense_id, {keys}, CASE WHEN NOT mixed THEN share END::BIGINT AS base_minor FROM ({allocate_sql(inner, 'expense_id', ', mixed', tie=keys)})"


IN_BASE = f"{BASED},\n{SHARES},\nconsumed AS ({_rescaled('shares', 'share_minor', 'person_id')}),\npaid AS ({_rescaled('expense_payment', 'amount_minor', 'person_id, payment_method_id')})"
ALL_VIEWS = "expense participant expense_share expense_payment line_item line_item_assignment exchange_rate settlement member grp"
GOOD = IN_BASE + ",\nbad AS (SELECT DISTINCT expense_id FROM consumed WHERE base_minor IS NULL)"
BALANCE = GOOD + """,
balance AS (SELECT group_id, person_id, sum(p)::BIGINT AS paid, sum(c)::BIGINT AS consumed, sum(o)::BIGINT AS settled_out, sum(i)::BIGINT AS settled_in, sum(p - c + o - i)::BIGINT AS balance FROM (
  SELECT e.group_id, x.person_id, x.base_minor AS p, 0 AS c, 0 AS o, 0 AS i FROM paid x JOIN expense e USING (expense_id) WHERE expense_id NOT IN (SELECT expense_id FROM bad)
  UNION ALL SELECT e.group_id, x.person_id, 0, x.base_minor, 0, 0 FROM consumed x JOIN expense e USING (expense_id) WHERE expense_id NOT IN (SELECT expense_id FROM bad)
  UNION ALL SELECT group_id, from_person, 0, 0, amount_minor, 0 FROM settlement WHERE currency = 'EUR'
  UNION ALL SELECT group_id, to_person, 0, 0, 0, amount_minor FROM settlement WHERE currency = 'EUR') GROUP BY 1, 2)"""


# ------------------------------------------------------------------ shared pieces in Spark
#: What balances ask of a line.
AMOUNTS = ["expense_id", "position", "total_minor", "kind", "attached"]


def legs(v: Views) -> DataFrame:
    return fx.both_directions(v.exchange_rate)


def based(v: Views) -> DataFrame:
    def build() -> DataFrame:
        v.keep("expense")
        return fx.convert_expenses(v.expense, legs(v), v.currency)[0]

    return v.once("based", build)


def itemised(v: Views) -> DataFrame:
    v.keep("line_item", "member", "expense")
    return split.itemised(v.expense, v.line_item, v.line_item_assignment, v.participant)


def _shares(v: Views) -> DataFrame:
    v.keep("line_item", "member", "expense")
    return split.shares(v.expense, v.expense_share, v.line_item, v.line_item_assignment, v.participant)


def all_shares(v: Views) -> DataFrame:
    return v.once("shares", lambda: _shares(v))


def shares_in_base(v: Views) -> DataFrame:
    return v.once("shares_in_base", lambda: split.in_base(all_shares(v), based(v), "share_minor"))


def payments_in_base(v: Views) -> DataFrame:
    return v.once("payments_in_base", lambda: split.in_base(v.expense_payment, based(v), "amount_minor"))


def parts(v: Views) -> DataFrame:
    """Paid and consumed in the base currency, with group_id, without rejected expenses."""

    def build() -> DataFrame:
        shares = all_shares(v)  # first, since it writes the views that ``based`` stands on
        return split.parts_in_base(shares, v.expense_payment, based(v), tasks=v.tasks("expense"))

    return v.once("parts", build)


def settled(v: Views) -> DataFrame:
    return v.settlement.where("currency = 'EUR'")


def facts(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """paid, consumed, settlements with group_id; paid and consumed are written once."""
    parts(v)
    v.keep("parts")
    return parts(v).where("kind = 'paid'").drop("kind"), parts(v).where("kind = 'consumed'").drop("kind"), settled(v)


def group_balances(v: Views) -> DataFrame:
    v.keep_narrow("line_item", AMOUNTS)
    return bal.balances_of_parts(parts(v), settled(v), ["group_id"])


# ------------------------------------------------------------------ money
EXP = "CASE currency WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END"


def _with_exponent(df: DataFrame, v: Views, on: str = "currency") -> DataFrame:
    return df.join(F.broadcast(v.currency.select(F.col("code").alias(on), "exponent")), on)


@query("MON1_from_major", f"""SELECT o_orderkey, CASE WHEN f = 0.5 THEN fl + fl % 2 ELSE fl + (f > 0.5)::INT END::BIGINT AS minor FROM (
SELECT o_orderkey, floor(x)::BIGINT AS fl, x - floor(x) AS f FROM (SELECT o_orderkey, (o_totalprice::DECIMAL(18,2)::DECIMAL(24,4) * 0.0625::DECIMAL(5,4) * CASE o_orderkey % 5 WHEN 2 THEN 1 WHEN 4 THEN 1000 ELSE 100 END)::DECIMAL(30,8) AS x FROM orders))""")
def mon1(v: Views) -> DataFrame:
    o = v.table("orders").select("o_orderkey", (F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(24,4)") * F.lit("0.0625").cast("decimal(5,4)")).alias("major"), F.element_at(F.array(*[F.lit(c) for c in ("EUR", "USD", "JPY", "GBP", "KWD")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("currency"))
    return _with_exponent(o, v).select("o_orderkey", money.from_major(F.col("major"), F.col("exponent")).alias("minor"))


@query("MON2_to_major", f"SELECT expense_id, (total_minor::DECIMAL(19,0) * CASE currency WHEN 'JPY' THEN 1 WHEN 'KWD' THEN 0.001 ELSE 0.01 END::DECIMAL(5,4))::DECIMAL(24,4) AS major FROM expense", "expense")
def mon2(v: Views) -> DataFrame:
    return _with_exponent(v.expense, v).select("expense_id", money.to_major(F.col("total_minor"), F.col("exponent")).alias("major"))


@query("MON3_checked_sums", "SELECT currency, sum(total_minor)::BIGINT AS total_minor, -sum(total_minor)::BIGINT AS negated, count(*) AS n FROM expense GROUP BY currency", "expense")
def mon3(v: Views) -> DataFrame:
    return v.expense.groupBy("currency").agg(F.sum("total_minor").alias("total_minor"), (-F.sum("total_minor")).alias("negated"), F.count("*").alias("n"))


@query("MON4_currency_lookup", "SELECT expense_id, code, exponent FROM (SELECT expense_id, ' ' || lower(currency) || ' ' AS typed FROM expense) e JOIN currency c ON upper(trim(typed)) = c.code WHERE contains(lower(c.name), 'o') OR contains(lower(c.code), 'kw')", "expense currency")
def mon4(v: Views) -> DataFrame:
    e = v.expense.select("expense_id", F.upper(F.trim(F.concat(F.lit(" "), F.lower("currency"), F.lit(" ")))).alias("code"))
    hit = F.lower("name").contains("o") | F.lower("code").contains("kw")
    return e.join(F.broadcast(v.currency.where(hit)), "code").select("expense_id", "code", "exponent")


@query("MON5_selectable_currencies", "SELECT c.code, c.name, count(e.expense_id) AS used FROM currency c LEFT JOIN expense e ON e.currency = c.code WHERE selectable GROUP BY 1, 2", "currency expense")
def mon5(v: Views) -> DataFrame:
    return v.expense.groupBy(F.col("currency").alias("code")).agg(F.count("*").alias("n")).join(F.broadcast(v.currency.where("selectable")), "code", "right").select("code", "name", F.coalesce("n", F.lit(0)).alias("used"))


@query("FX1_convert", f"""SELECT expense_id, (sign(total_minor) * {half_even_sql("abs(total_minor)::HUGEINT * 10873500000 * CASE currency WHEN 'JPY' THEN 100 ELSE 1 END", "10000000000::HUGEINT * CASE currency WHEN 'KWD' THEN 10 ELSE 1 END")})::BIGINT AS usd_minor FROM expense""", "expense")
def fx1(v: Views) -> DataFrame:
    df = _with_exponent(v.expense, v)
    return df.select("expense_id", money.convert(F.col("total_minor"), F.lit(10873500000), F.lit(money.RATE_SCALE), F.col("exponent"), F.lit(2)).alias("usd_minor"))


@query("FX2_inverse", f"""SELECT expense_id, {half_even_sql("total_minor::HUGEINT * 10000000000", "1623500000000")}::BIGINT AS through_inverse FROM expense""", "expense")
def fx2(v: Views) -> DataFrame:
    return v.expense.select("expense_id", money.convert(F.col("total_minor"), F.lit(money.RATE_SCALE), F.lit(1623500000000), F.lit(2), F.lit(2)).alias("through_inverse"))


@query("FX4_implied_rate", f"SELECT settlement_id, {half_even_sql('total_minor::HUGEINT * 7 * 1000000', 'amount_minor')}::BIGINT AS implied_millionths FROM (SELECT s.settlement_id, s.amount_minor, e.total_minor FROM settlement s JOIN expense e ON e.expense_id = s.settlement_id) WHERE amount_minor > 0", "settlement expense")
def fx4(v: Views) -> DataFrame:
    s = v.settlement.join(v.expense.select(F.col("expense_id").alias("settlement_id"), "total_minor"), "settlement_id").where("amount_minor > 0")
    # the pair (to, from) is kept; it is written out only here
    n, d = (F.col("total_minor").cast("decimal(19,0)") * 7 * 1000000).cast(money.WIDE), F.col("amount_minor").cast(money.WIDE)
    return s.select("settlement_id", money.half_even_div(n, d).alias("implied_millionths"))


@query("FX5_read_as", "SELECT id, quote AS from_cur, 10000000000::HUGEINT::DECIMAL(38,0) AS num, (rate * 10000000000)::DECIMAL(38,0) AS den FROM exchange_rate", "exchange_rate")
def fx5(v: Views) -> DataFrame:
    wanted = v.exchange_rate.select(F.col("id").alias("rate_id"), F.col("quote").alias("from_cur"), F.col("base").alias("to_cur"))
    return fx.archived_rate(wanted, v.exchange_rate).select(F.col("rate_id").alias("id"), "from_cur", F.col("num").cast("decimal(38,0)").alias("num"), F.col("den").cast("decimal(38,0)").alias("den"))


@query("FX6_withdrawal_fee", f"""SELECT expense_id, CASE WHEN currency = 'EUR' THEN 50 ELSE 50 + {half_even_sql("total_minor::HUGEINT * 175", "10000")} END::BIGINT AS fee_minor FROM expense""", "expense")
def fx6(v: Views) -> DataFrame:
    card = v.method.where("method_id = 'm1'").select("foreign_percent", "fixed_minor", "fixed_currency")
    df = v.expense.crossJoin(F.broadcast(card))  # one row
    fee = money.withdrawal_fee(F.col("total_minor"), F.col("currency") != "EUR", F.col("fixed_minor"), F.lit(True), F.col("foreign_percent"))
    return df.select("expense_id", fee.cast("bigint").alias("fee_minor"))


@query("FX7_charge_currency", "SELECT p.expense_id, p.person_id, coalesce(m.fixed_currency, 'EUR') AS charge_currency FROM expense_payment p LEFT JOIN method m ON m.method_id = p.payment_method_id", "expense_payment method")
def fx7(v: Views) -> DataFrame:
    m = v.method.select(F.col("method_id").alias("payment_method_id"), "fixed_currency")
    return v.expense_payment.join(m, "payment_method_id", "left").select("expense_id", "person_id", F.coalesce("fixed_currency", F.lit("EUR")).alias("charge_currency"))


@query("FX8_line_total", """SELECT expense_id, position, (CASE WHEN f = 0.5 THEN fl + fl % 2 ELSE fl + (f > 0.5)::INT END)::BIGINT AS line_minor, fl + 0 <= total_minor + 1 AND abs(x - total_minor) < 1 AS fits FROM (
SELECT *, floor(x)::BIGINT AS fl, x - floor(x) AS f FROM (SELECT expense_id, position, total_minor, (quantity * 0.25::DECIMAL(3,2) * abs(total_minor % 1000))::DECIMAL(30,8) AS x FROM line_item))""", "line_item")
def fx8(v: Views) -> DataFrame:
    q, u = (F.col("quantity") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(12,6)"), F.abs(F.col("total_minor") % 1000)
    return v.line_item.select("expense_id", "position", money.line_total(q, u).alias("line_minor"), money.quantity_fits(q, u, F.col("total_minor")).alias("fits"))


@query("FX9_money_text", """SELECT expense_id, s || regexp_replace(w, '', '') || CASE WHEN e > 0 THEN '.' || p ELSE '' END AS shown FROM (
SELECT expense_id, e, s, CASE WHEN length(w) > 6 THEN w[:length(w)-6] || ',' || w[length(w)-5:length(w)-3] || ',' || w[length(w)-2:] WHEN length(w) > 3 THEN w[:length(w)-3] || ',' || w[length(w)-2:] ELSE w END AS w, p FROM (
SELECT expense_id, e, s, (total_minor // (10 ** e)::BIGINT)::VARCHAR AS w, lpad((total_minor % (10 ** e)::BIGINT)::VARCHAR, e::INT, '0') AS p FROM (
SELECT expense_id, total_minor, CASE currency WHEN 'JPY' THEN 0 WHEN 'KWD' THEN 3 ELSE 2 END AS e, CASE currency WHEN 'EUR' THEN '€' WHEN 'JPY' THEN '¥' WHEN 'GBP' THEN '£' ELSE currency || ' ' END AS s FROM expense)))""", "expense")
def fx9(v: Views) -> DataFrame:
    signs = F.when(F.col("currency") == "EUR", "€").when(F.col("currency") == "JPY", "¥").when(F.col("currency") == "GBP", "£").otherwise(F.concat("currency", F.lit(" ")))
    return _with_exponent(v.expense, v).select("expense_id", money.money_text(F.col("total_minor"), F.col("exponent"), signs).alias("shown"))


@query("FX10_parse_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice::DECIMAL(18,2))::BIGINT END ELSE (o_totalprice::DECIMAL(18,2) * CASE WHEN o_orderkey % 5 = 4 THEN 1000 ELSE 100 END)::BIGINT END AS minor FROM orders")
def fx10(v: Views) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    o = v.table("orders").select("o_orderkey", F.when((F.col("o_orderkey") % 5 == 2) & (F.col("o_orderkey") % 2 == 0), F.floor(price).cast("string")).otherwise(price.cast("string")).alias("typed"), F.when(F.col("o_orderkey") % 5 == 2, 0).when(F.col("o_orderkey") % 5 == 4, 3).otherwise(2).alias("exponent"))
    return o.select("o_orderkey", money.parse_amount(F.concat(F.lit(" "), F.col("typed")), F.col("exponent")).alias("minor"))


@query("FX11_fit_decimals", "SELECT expense_id, CASE currency WHEN 'JPY' THEN total_minor * 100 WHEN 'KWD' THEN total_minor // 10 ELSE total_minor END AS as_eur, CASE currency WHEN 'JPY' THEN total_minor WHEN 'KWD' THEN total_minor // 1000 ELSE total_minor // 100 END AS as_jpy FROM expense", "expense")
def fx11(v: Views) -> DataFrame:
    df = _with_exponent(v.expense, v)
    return df.select("expense_id", money.fit_decimals(F.col("total_minor"), F.col("exponent"), F.lit(2)).alias("as_eur"), money.fit_decimals(F.col("total_minor"), F.col("exponent"), F.lit(0)).alias("as_jpy"))


# ------------------------------------------------------------------ rates
@query("FXR1_both_directions", "SELECT base, quote, (rate * 10000000000)::DECIMAL(38,0) AS num, 10000000000::HUGEINT::DECIMAL(38,0) AS den, id FROM exchange_rate WHERE source <> 'manual' UNION ALL SELECT quote, base, 10000000000::HUGEINT::DECIMAL(38,0), (rate * 10000000000)::DECIMAL(38,0), id FROM exchange_rate WHERE source <> 'manual'", "exchange_rate")
def fxr1(v: Views) -> DataFrame:
    return legs(v).select("base", "quote", F.col("num").cast("decimal(38,0)").alias("num"), F.col("den").cast("decimal(38,0)").alias("den"), "id")


@query("FXR2_newest_per_day", "SELECT base, quote, rate_date, source, arg_max(id, fetched_at) AS id, max(fetched_at) AS fetched_at FROM exchange_rate GROUP BY 1, 2, 3, 4", "exchange_rate")
def fxr2(v: Views) -> DataFrame:
    return fx.newest_per_day(v.exchange_rate).select("base", "quote", "rate_date", "source", "id", "fetched_at")


WANTED = "wanted AS (SELECT DISTINCT expense_id, currency AS quote, occurred_date AS day FROM expense WHERE currency <> 'EUR')"


def _wanted(v: Views) -> DataFrame:
    return v.expense.where("currency <> 'EUR'").select("expense_id", F.lit("EUR").alias("from_cur"), F.col("currency").alias("to_cur"), F.col("occurred_date").alias("day"))


@query("FXR3_rate_on", "SELECT w.expense_id, r.id, r.rate_date FROM wanted w ASOF LEFT JOIN rate r ON w.quote = r.quote AND w.day >= r.rate_date", "expense exchange_rate", f"{RATE},\n{WANTED}")
def fxr3(v: Views) -> DataFrame:
    return fx.rate_on(_wanted(v), legs(v)).select("expense_id", "id", "rate_date")


@query("FXR4_rate_near", "SELECT w.expense_id, coalesce(r.id, f.id) AS id, coalesce(r.rate_date, f.rate_date) AS rate_date, r.id IS NULL AS later FROM wanted w ASOF LEFT JOIN rate r ON w.quote = r.quote AND w.day >= r.rate_date LEFT JOIN rate f ON f.quote = w.quote AND f.nth = 1", "expense exchange_rate", f"{RATE},\n{WANTED}")
def fxr4(v: Views) -> DataFrame:
    return fx.rate_near(_wanted(v), legs(v)).select("expense_id", "id", "rate_date", "later")


@query("FXR5_latest", "SELECT quote, arg_max(id, (rate_date, fetched_at, id)) AS id, max(rate_date) AS rate_date FROM exchange_rate GROUP BY quote", "exchange_rate")
def fxr5(v: Views) -> DataFrame:
    return fx.latest(legs(v)).where("base = 'EUR'").select("quote", "id", "rate_date")


@query("FXR6_resolve", """SELECT e.expense_id, CASE WHEN e.currency = 'USD' THEN '' WHEN e.currency = 'EUR' THEN b.id WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN a.id || '+' || b.id END AS legs,
CASE WHEN e.currency = 'USD' THEN NULL WHEN e.currency = 'EUR' THEN b.rate_date WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN least(a.rate_date, b.rate_date) END AS quote_date FROM expense e
LEFT JOIN rate a ON a.quote = e.currency AND e.occurred_date >= a.rate_date AND (a.valid_to IS NULL OR e.occurred_date < a.valid_to)
LEFT JOIN rate b ON b.quote = 'USD' AND e.occurred_date >= b.rate_date AND (b.valid_to IS NULL OR e.occurred_date < b.valid_to)""", "expense exchange_rate", RATE)
def fxr6(v: Views) -> DataFrame:
    w = v.expense.select("expense_id", F.col("currency").alias("from_cur"), F.lit("USD").alias("to_cur"), F.col("occurred_date").alias("day"))
    return fx.resolve(w, legs(v)).select("expense_id", F.when(F.col("legs").isNotNull(), F.array_join("legs", "+")).alias("legs"), "quote_date")


@query("FX3_chain", f"""SELECT e.expense_id, CASE WHEN e.currency = 'USD' THEN e.total_minor WHEN e.currency = 'EUR' THEN {half_even_sql("e.total_minor::HUGEINT * b.num", "10000000000::HUGEINT")}
ELSE {half_even_sql("e.total_minor::HUGEINT * b.num * CASE e.currency WHEN 'JPY' THEN 100 ELSE 1 END", "a.num * CASE e.currency WHEN 'KWD' THEN 10 ELSE 1 END")} END::BIGINT AS usd_minor FROM expense e
LEFT JOIN rate a ON a.quote = e.currency AND e.occurred_date >= a.rate_date AND (a.valid_to IS NULL OR e.occurred_date < a.valid_to)
LEFT JOIN rate b ON b.quote = 'USD' AND e.occurred_date >= b.rate_date AND (b.valid_to IS NULL OR e.occurred_date < b.valid_to)""", "expense exchange_rate", RATE)
def fx3(v: Views) -> DataFrame:
    w = v.expense.select("expense_id", "total_minor", "currency", F.col("currency").alias("from_cur"), F.lit("USD").alias("to_cur"), F.col("occurred_date").alias("day"))
    df = _with_exponent(fx.resolve(w, legs(v)), v)
    return df.select("expense_id", F.when(F.col("from_cur") == "USD", F.col("total_minor")).otherwise(money.convert(F.col("total_minor"), F.col("num"), F.col("den"), F.col("exponent"), F.lit(2))).alias("usd_minor"))


@query("FXR7_history", """SELECT line, rate_date, id FROM (SELECT row_number() OVER (ORDER BY rate_date DESC, fetched_at DESC, id DESC) AS line, rate_date, id FROM (
SELECT rate_date, source, max(fetched_at) AS fetched_at, arg_max(id, fetched_at) AS id FROM exchange_rate WHERE quote = 'USD' GROUP BY 1, 2)) WHERE line <= 400""", "exchange_rate")
def fxr7(v: Views) -> DataFrame:
    return fx.history(v.exchange_rate, "EUR", "USD").select("line", "rate_date", F.col("legs")[0].alias("id"))


@query("FXR7_crossed_history", """SELECT line, rate_date, legs FROM (SELECT row_number() OVER (ORDER BY rate_date DESC, fetched_at DESC, legs DESC) AS line, rate_date, legs FROM (
SELECT DISTINCT greatest(a.rate_date, b.rate_date) AS rate_date, least(a.fetched_at, b.fetched_at) AS fetched_at, a.id || '+' || b.id AS legs FROM (SELECT DISTINCT rate_date AS day FROM rate WHERE quote IN ('JPY', 'GBP')) d
ASOF JOIN (SELECT * FROM rate WHERE quote = 'JPY') a ON d.day >= a.rate_date ASOF JOIN (SELECT * FROM rate WHERE quote = 'GBP') b ON d.day >= b.rate_date)) WHERE line <= 400""", "exchange_rate", RATE)
def fxr7_crossed(v: Views) -> DataFrame:
    return fx.history(v.exchange_rate, "JPY", "GBP").select("line", "rate_date", F.array_join("legs", "+").alias("legs"))


@query("FXR8_convert_expenses", "SELECT expense_id, total_base_minor::BIGINT AS total_base_minor FROM based", "expense exchange_rate", BASED)
def fxr8(v: Views) -> DataFrame:
    return based(v).select("expense_id", "total_base_minor")


@query("FXR9_chosen_rate", """SELECT e.expense_id, CASE WHEN e.currency = 'EUR' THEN 'none' WHEN coalesce(r.id, f.id) IS NOT NULL THEN 'direct:' || coalesce(r.id, f.id) END AS chosen FROM expense e
LEFT JOIN rate r ON r.quote = e.currency AND e.occurred_date >= r.rate_date AND (r.valid_to IS NULL OR e.occurred_date < r.valid_to) LEFT JOIN rate f ON f.quote = e.currency AND f.nth = 1""", "expense exchange_rate", RATE)
def fxr9(v: Views) -> DataFrame:
    return based(v).select("expense_id", fx.chosen_rate(F.col("legs")).alias("chosen"))


@query("FXR10_rerate", "SELECT expense_id, expense_id % 4 <> 1 AND expense_id % 6 <> 2 AS keeps_rate FROM expense", "expense")
def fxr10(v: Views) -> DataFrame:
    old = v.expense.select("expense_id", "occurred_date", "currency", F.lit("EUR").alias("base_currency"), F.lit(None).cast("string").alias("own_rate"))
    new = old.withColumn("occurred_date", F.when(F.col("expense_id") % 4 == 1, F.date_add("occurred_date", 1)).otherwise(F.col("occurred_date"))).withColumn("own_rate", F.when(F.col("expense_id") % 6 == 2, "1.5"))
    return fx.rerate(old, new).select("expense_id", "keeps_rate")


@query("FXR11_fallback", "SELECT id, quote, source FROM exchange_rate WHERE source = 'main' AND quote <> 'KWD' UNION ALL SELECT id, quote, source FROM exchange_rate WHERE source = 'backup' AND quote = 'KWD'", "exchange_rate")
def fxr11(v: Views) -> DataFrame:
    r = v.exchange_rate
    return fx.fill_from_fallback(r.where("source = 'main' AND quote <> 'KWD'"), r.where("source = 'backup'"), r, "main", False).select("id", "quote", "source")


@query("FXR12_day_missing", "SELECT w.expense_id, r.id IS NULL OR r.rate_date < w.day - 4 AS missing FROM wanted w ASOF LEFT JOIN rate r ON w.quote = r.quote AND w.day >= r.rate_date", "expense exchange_rate", f"{RATE},\n{WANTED}")
def fxr12(v: Views) -> DataFrame:
    return fx.rate_on(_wanted(v), legs(v)).select("expense_id", fx.day_missing(F.col("rate_date"), F.col("day"), F.lit(False)).alias("missing"))


@query("FXR13_stale", "SELECT id, fetched_at < 86400000::BIGINT * 2000 - 24 * 3600000 AS stale FROM exchange_rate", "exchange_rate")
def fxr13(v: Views) -> DataFrame:
    return v.exchange_rate.select("id", fx.is_stale(F.col("fetched_at"), F.lit(86400000 * 2000)).alias("stale"))


@query("FXR14_board", "SELECT quote AS code, CASE WHEN quote = 'GBP' THEN 8500000000 ELSE arg_max((rate * 10000000000)::HUGEINT, (rate_date, fetched_at, id)) END::DECIMAL(38,0) AS num, quote = 'GBP' AS own FROM exchange_rate GROUP BY quote", "exchange_rate")
def fxr14(v: Views) -> DataFrame:
    manual = v.currency.where("code = 'GBP'").select("code", F.lit(8500000000).cast("decimal(20,0)").alias("num"), F.lit(money.RATE_SCALE).cast("decimal(20,0)").alias("den"))
    return fx.board(v.currency.where("selectable").select("code"), legs(v), "EUR", manual).select("code", F.col("num").cast("decimal(38,0)").alias("num"), "own")


@query("FXR15_last_fetch", "SELECT source, max(fetched_at) AS last_fetch, count(DISTINCT quote) AS quotes FROM exchange_rate GROUP BY source", "exchange_rate")
def fxr15(v: Views) -> DataFrame:
    return v.exchange_rate.groupBy("source").agg(F.max("fetched_at").alias("last_fetch"), F.countDistinct("quote").alias("quotes"))


@query("FXR16_archived_rate", "SELECT id, CASE WHEN quote = 'USD' THEN (rate * 10000000000)::DECIMAL(38,0) END AS num FROM exchange_rate", "exchange_rate")
def fxr16(v: Views) -> DataFrame:
    w = v.exchange_rate.select(F.col("id").alias("rate_id"), F.lit("EUR").alias("from_cur"), F.lit("USD").alias("to_cur"))
    return fx.archived_rate(w, v.exchange_rate).select(F.col("rate_id").alias("id"), F.col("num").cast("decimal(38,0)").alias("num"))


# ------------------------------------------------------------------ splits
@query("SPL1_allocate", f"SELECT expense_id, person_id, share::BIGINT AS share_minor FROM ({allocate_sql('SELECT p.expense_id, p.person_id, e.total_minor AS total, (p.weight * 1000000)::HUGEINT AS w FROM participant p JOIN expense e ON e.expense_id = p.expense_id', 'expense_id')})", "expense participant")
def spl1(v: Views) -> DataFrame:
    df = v.participant.join(v.expense.select("expense_id", "total_minor"), "expense_id")
    return split.allocate(df, ["expense_id"], F.col("total_minor"), F.col("weight"), ["person_id"]).select("expense_id", "person_id", "share_minor")


@query("SPL2_rescale", f"SELECT expense_id, person_id, base_minor FROM ({_rescaled('shares', 'share_minor', 'person_id')})", ALL_VIEWS, f"{BASED},\n{SHARES}")
def spl2(v: Views) -> DataFrame:
    return shares_in_base(v).select("expense_id", "person_id", "base_minor")


for _name, _mode in (("SPL3_equal", "equal"), ("SPL4_weights", "weights"), ("SPL5_percent", "percent"), ("SPL6_exact", "exact")):

    @query(_name, f"SELECT s.expense_id, s.person_id, s.share_minor FROM shares s JOIN expense e USING (expense_id) WHERE split_mode = '{_mode}'", ALL_VIEWS, SHARES)
    def _spl_mode(v: Views, mode: str = _mode) -> DataFrame:
        return split.by_mode(v.expense.where(F.col("split_mode") == mode), v.expense_share)


@query("SPL7_effective_owner", "SELECT expense_id, position, owner FROM owned", ALL_VIEWS, SHARES)
def spl7(v: Views) -> DataFrame:
    return split.effective_owner(v.line_item).select("expense_id", "position", "owner")


@query("SPL8_assignable", "SELECT kind, count(*) AS n, sum(total_minor)::BIGINT AS total FROM line_item WHERE kind IN ('article', 'discount', 'deposit') GROUP BY kind", "line_item")
def spl8(v: Views) -> DataFrame:
    return split.assignable(v.line_item).groupBy("kind").agg(F.count("*").alias("n"), F.sum("total_minor").alias("total"))


@query("SPL9_itemised", "SELECT s.expense_id, s.person_id, s.share_minor FROM shares s JOIN expense e USING (expense_id) WHERE split_mode = 'items'", ALL_VIEWS, SHARES)
def spl9(v: Views) -> DataFrame:
    return itemised(v)


@query("SPL10_participants", "SELECT expense_id, count(DISTINCT person_id) AS people FROM shares GROUP BY expense_id", ALL_VIEWS, SHARES)
def spl10(v: Views) -> DataFrame:
    return all_shares(v).select("expense_id", "person_id").distinct().groupBy("expense_id").agg(F.count("*").alias("people"))


@query("SPL11_shares_in_base", "SELECT expense_id, sum(base_minor)::BIGINT AS consumed, count(base_minor) AS n FROM consumed GROUP BY expense_id", ALL_VIEWS, IN_BASE)
def spl11(v: Views) -> DataFrame:
    return shares_in_base(v).groupBy("expense_id").agg(F.sum("base_minor").alias("consumed"), F.count("base_minor").alias("n"))


@query("SPL12_payments_in_base", "SELECT expense_id, person_id, payment_method_id, base_minor FROM paid", ALL_VIEWS, IN_BASE)
def spl12(v: Views) -> DataFrame:
    return payments_in_base(v).select("expense_id", "person_id", "payment_method_id", "base_minor")


@query("SPL13_general_part", "SELECT o.expense_id, sum(o.total_minor)::BIGINT AS general_minor FROM owned o LEFT JOIN holders h ON h.expense_id = o.expense_id AND h.position = o.owner WHERE h.hk IS NULL GROUP BY 1", ALL_VIEWS, SHARES)
def spl13(v: Views) -> DataFrame:
    return split.general_part(v.line_item, v.line_item_assignment)


@query("SPL14_equal_payments", "SELECT expense_id, person_id, (total_minor // n + CASE WHEN row_number() OVER (PARTITION BY expense_id ORDER BY person_id) <= total_minor % n THEN 1 ELSE 0 END)::BIGINT AS part FROM (SELECT p.expense_id, p.person_id, e.total_minor, count(*) OVER (PARTITION BY p.expense_id) AS n FROM expense_payment p JOIN expense e USING (expense_id))", "expense expense_payment")
def spl14(v: Views) -> DataFrame:
    df = v.expense_payment.join(v.expense.select("expense_id", "total_minor"), "expense_id")
    return split.allocate(df, ["expense_id"], F.col("total_minor"), F.lit(1), ["person_id"], "part").select("expense_id", "person_id", "part")


@query("SPL15_split_line", f"""SELECT expense_id, position, half, share::BIGINT AS half_minor FROM ({allocate_sql("SELECT expense_id, position, half, total_minor AS total, CASE WHEN peel THEN CASE half WHEN 1 THEN quantity - 1 ELSE 1 END * 1000000 ELSE 1000000 END::HUGEINT AS w FROM (SELECT l.*, h.half, quantity = floor(quantity) AND quantity >= 2 AS peel FROM line_item l CROSS JOIN (VALUES (1), (2)) h(half) WHERE abs(total_minor) >= 2)", "expense_id, position", tie="half")})""", "line_item")
def spl15(v: Views) -> DataFrame:
    return split.split_line(v.line_item).select("expense_id", "position", "half", "half_minor")


@query("SPL16_merge_lines", "SELECT expense_id, slot, CASE WHEN k = 1 AND t = 1 THEN t1 ELSE joined END AS text, CASE WHEN k = 1 AND t = 1 THEN q ELSE 1 END::DECIMAL(22,6) AS quantity, CASE WHEN k = 1 THEN k1 ELSE 'article' END AS kind, total_minor FROM (SELECT expense_id, position // 3 AS slot, count(DISTINCT text) AS t, count(DISTINCT kind) AS k, min(text) AS t1, min(kind) AS k1, string_agg(text, ' + ' ORDER BY position) AS joined, sum(quantity) AS q, sum(total_minor)::BIGINT AS total_minor FROM line_item GROUP BY 1, 2)", "line_item")
def spl16(v: Views) -> DataFrame:
    return split.merge_lines(v.line_item.withColumn("slot", F.floor(F.col("position") / 3)), ["expense_id", "slot"])


@query("SPL17_items_difference", "SELECT e.expense_id, coalesce(s.items, 0)::BIGINT AS items_minor, (e.total_minor - coalesce(s.items, 0))::BIGINT AS difference FROM expense e LEFT JOIN (SELECT expense_id, sum(total_minor) AS items FROM line_item GROUP BY 1) s USING (expense_id)", "expense line_item")
def spl17(v: Views) -> DataFrame:
    return split.items_difference(v.expense, v.line_item)


@query("SPL18_signed_text", "SELECT expense_id, position, CASE WHEN kind = 'discount' THEN -abs(total_minor) ELSE abs(total_minor) END AS signed_minor, coalesce(CASE WHEN position % 3 = 0 THEN 'own ' || text END, CASE WHEN position % 2 = 0 THEN 'translated ' || text END, text) AS shown FROM line_item", "line_item")
def spl18(v: Views) -> DataFrame:
    own, other = F.when(F.col("position") % 3 == 0, F.concat(F.lit("own "), F.col("text"))), F.when(F.col("position") % 2 == 0, F.concat(F.lit("translated "), F.col("text")))
    return v.line_item.select("expense_id", "position", F.when(F.col("kind") == "discount", -F.abs("total_minor")).otherwise(F.abs("total_minor")).alias("signed_minor"), F.coalesce(own, other, F.col("text")).alias("shown"))


# ------------------------------------------------------------------ balances
@query("BAL1_balances", "SELECT * FROM balance", ALL_VIEWS, BALANCE)
def bal1(v: Views) -> DataFrame:
    return group_balances(v)


@query("BAL2_summary", "SELECT m.group_id, m.person_id, coalesce(b.paid, 0)::BIGINT AS paid, coalesce(b.consumed, 0)::BIGINT AS consumed, coalesce(b.settled_out, 0)::BIGINT AS settled_out, coalesce(b.settled_in, 0)::BIGINT AS settled_in, coalesce(b.balance, 0)::BIGINT AS balance FROM member m LEFT JOIN balance b USING (group_id, person_id)", ALL_VIEWS, BALANCE)
def bal2(v: Views) -> DataFrame:
    return bal.with_members(group_balances(v), v.member)


@query("BAL2_group_totals", "SELECT g.group_id, coalesce(sum(CASE WHEN b.expense_id % 9 <> 4 THEN b.total_base_minor END), 0)::BIGINT AS total, count(CASE WHEN b.expense_id % 9 <> 4 THEN 1 END) AS counted, count(CASE WHEN b.expense_id % 9 = 4 THEN 1 END) AS skipped FROM grp g LEFT JOIN based b USING (group_id) GROUP BY 1", ALL_VIEWS, BASED)
def bal2_totals(v: Views) -> DataFrame:
    e = based(v).withColumn("base_currency", F.when(F.col("expense_id") % 9 == 4, "USD").otherwise(F.col("base_currency")))
    return bal.group_totals(v.grp, e)


@query("BAL3_rankings", "SELECT group_id, person_id, row_number() OVER (PARTITION BY group_id ORDER BY paid DESC, person_id) AS paid_rank, row_number() OVER (PARTITION BY group_id ORDER BY balance, person_id) AS owes_rank FROM balance", ALL_VIEWS, BALANCE)
def bal3(v: Views) -> DataFrame:
    return bal.rankings(group_balances(v)).select("group_id", "person_id", "paid_rank", "owes_rank")


@query("BAL4_simplified_debts")
def bal4(v: Views) -> DataFrame:
    return bal.simplified_debts(group_balances(v))


FLOWS = GOOD + """,
fit AS (SELECT c.expense_id FROM consumed c JOIN based b USING (expense_id) WHERE b.total_base_minor > 0 GROUP BY 1 HAVING min(c.base_minor) >= 0 AND count(*) = count(c.base_minor)),
pays AS (SELECT expense_id, person_id, sum(base_minor)::HUGEINT AS paid, sum(sum(base_minor)) OVER (PARTITION BY expense_id)::HUGEINT AS total FROM paid JOIN fit USING (expense_id) GROUP BY 1, 2),
cell AS (SELECT c.expense_id, c.person_id AS f, p.person_id AS t, c.base_minor::HUGEINT AS owed, p.paid, c.base_minor::HUGEINT * p.paid // p.total AS whole FROM consumed c JOIN pays p USING (expense_id)),
lefts AS (SELECT *, owed - sum(whole) OVER (PARTITION BY expense_id, f) AS rl, paid - sum(whole) OVER (PARTITION BY expense_id, t) AS cl FROM cell),
ends AS (SELECT *, sum(rl) OVER (PARTITION BY expense_id, t ORDER BY f) AS re, sum(cl) OVER (PARTITION BY expense_id, f ORDER BY t) AS ce FROM lefts),
flow AS (SELECT expense_id, f AS from_person, t AS to_person, (whole + greatest(0, least(re, ce) - greatest(re - rl, ce - cl)))::BIGINT AS amount_minor FROM ends)"""


def flows(v: Views) -> DataFrame:
    """(group_id, expense_id, from_person, to_person, amount_minor)."""
    v.keep_narrow("line_item", AMOUNTS)
    return bal.flows_of_parts(parts(v), ["group_id", "expense_id"])


@query("BAL5_expense_flows", "SELECT * FROM flow WHERE amount_minor <> 0", ALL_VIEWS, FLOWS)
def bal5(v: Views) -> DataFrame:
    return flows(v).drop("group_id")


@query("BAL6_flow_fallback")
def bal6(v: Views) -> DataFrame:
    """Expenses with a negative share, in their own currency."""
    v.keep_narrow("line_item", AMOUNTS)
    all_shares(v)
    v.keep("shares")
    bad = all_shares(v).groupBy("expense_id").agg(F.min("share_minor").alias("low")).where("low < 0").select("expense_id")
    share = all_shares(v).join(bad, "expense_id", "left_semi").withColumnRenamed("share_minor", "base_minor")
    payment = v.expense_payment.join(bad, "expense_id", "left_semi").withColumnRenamed("amount_minor", "base_minor")
    return bal.flow_fallback(share, payment)


NET = FLOWS + """,
net AS (SELECT group_id, least(f, t) AS low, greatest(f, t) AS high, sum(CASE WHEN f < t THEN a ELSE -a END) AS n FROM (SELECT e.group_id, from_person AS f, to_person AS t, amount_minor AS a FROM flow JOIN expense e USING (expense_id) UNION ALL SELECT group_id, to_person, from_person, amount_minor FROM settlement WHERE currency = 'EUR') WHERE f <> t GROUP BY 1, 2, 3)"""


@query("BAL7_pairwise_net", "SELECT group_id, CASE WHEN n > 0 THEN low ELSE high END AS from_person, CASE WHEN n > 0 THEN high ELSE low END AS to_person, abs(n)::BIGINT AS amount_minor FROM net WHERE n <> 0", ALL_VIEWS, NET)
def bal7(v: Views) -> DataFrame:
    return bal.pairwise_net(flows(v), settled(v))


@query("BAL8_pairwise_debts")
def bal8(v: Views) -> DataFrame:
    return bal.pairwise_debts(flows(v), settled(v))


@query("BAL9_person_totals", "SELECT person_id, g.base_currency, sum(balance)::BIGINT AS balance, count(*) AS groups FROM balance JOIN grp g USING (group_id) GROUP BY 1, 2", ALL_VIEWS, BALANCE)
def bal9(v: Views) -> DataFrame:
    return group_balances(v).join(v.grp, "group_id").groupBy("person_id", "base_currency").agg(F.sum("balance").alias("balance"), F.count("*").alias("groups"))


@query("BAL10_group_list", "SELECT m.group_id, count(*) AS members, string_agg(m.person_id, ',' ORDER BY m.person_id) AS people, sum(CASE WHEN m.idx = 0 THEN coalesce(b.balance, 0) END)::BIGINT AS own_balance FROM member m LEFT JOIN balance b USING (group_id, person_id) GROUP BY 1", ALL_VIEWS, BALANCE)
def bal10(v: Views) -> DataFrame:
    df = v.member.join(group_balances(v), ["group_id", "person_id"], "left")
    return df.groupBy("group_id").agg(F.count("*").alias("members"), F.array_join(F.sort_array(F.collect_list("person_id")), ",").alias("people"), F.sum(F.when(F.col("idx") == 0, F.coalesce("balance", F.lit(0)))).alias("own_balance"))
