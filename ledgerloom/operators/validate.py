"""Validation jobs: (ok, rejects[id, rule]) for whole tables; the first broken rule names
the reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition (of being broken) holds, or NULL."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def validated(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("rule", first_broken(rules))
    return checked.where("rule IS NULL").drop("rule"), checked.where("rule IS NOT NULL")


def payments(expense: DataFrame, payment: DataFrame) -> DataFrame:
    """(expense_id, rule) of every expense; rule NULL if its payments are right."""
    p = payment.groupBy("expense_id").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("people"), F.min("amount_minor").alias("low"), F.sum("amount_minor").alias("paid"))
    df = expense.select("expense_id", "total_minor").join(p, "expense_id", "left")
    rules = [("total", F.col("total_minor") <= 0), ("no_payer", F.coalesce("n", F.lit(0)) == 0), ("payment", F.col("low") <= 0), ("payer_twice", F.col("people") < F.col("n")), ("sum", F.col("paid") != F.col("total_minor"))]
    return df.select("expense_id", first_broken(rules).alias("rule"))


def splits(expense: DataFrame, share: DataFrame) -> DataFrame:
    s = share.groupBy("expense_id").agg(F.count("*").alias("n"), F.min("amount_minor").alias("low"), F.sum("amount_minor").alias("exact"), F.sum("percent").alias("percent"), F.min("weight").alias("low_weight"), F.sum("weight").alias("weights"))
    df = expense.select("expense_id", "total_minor", "split_mode").join(s, "expense_id", "left")
    mode = lambda m: F.col("split_mode") == m
    rules = [
        ("nobody", F.coalesce("n", F.lit(0)) == 0), ("exact_negative", mode("exact") & (F.col("low") < 0)), ("percent_sum", mode("percent") & (F.col("percent") != 100)),
        ("exact_sum", mode("exact") & (F.col("exact") != F.col("total_minor"))), ("weight_negative", mode("weights") & (F.col("low_weight") < 0)), ("weights_zero", mode("weights") & (F.col("weights") == 0)),
    ]
    return df.select("expense_id", first_broken(rules).alias("rule"))


def valid_occurred_at(text: Column) -> Column:
    """A real date, a 24-hour time, and Z or an offset of up to 23 hours."""
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$")
    return F.coalesce(shape & valid_date(F.substring(text, 1, 10)), F.lit(False))


def valid_date(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull() & ~text.startswith("0000"), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def valid_period(start: Column, end: Column) -> Column:
    s, e = blank_to_null(start), blank_to_null(end)
    good = lambda x: x.isNull() | valid_date(x)
    return good(s) & good(e) & F.coalesce(e >= s, F.lit(True))


def settlements(settlement: DataFrame, group: DataFrame) -> DataFrame:
    df = settlement.join(group.select("group_id", "base_currency"), "group_id")
    rules = [("same_person", F.col("from_person") == F.col("to_person")), ("amount", F.col("amount_minor") <= 0), ("time", ~valid_occurred_at(F.col("occurred_at"))), ("currency", F.col("currency") != F.col("base_currency"))]
    return df.select("settlement_id", first_broken(rules).alias("rule"))


def line_items(items: DataFrame) -> DataFrame:
    bad_sign = F.when(F.col("kind") == "discount", F.col("total_minor") > 0).otherwise(F.col("total_minor") < 0)
    return items.select("expense_id", "position", first_broken([("quantity", F.col("quantity") <= 0), ("sign", bad_sign)]).alias("rule"))


def strangers(payment: DataFrame, expense: DataFrame, member: DataFrame) -> DataFrame:
    """(expense_id, person_id) of payers that are no members of the group."""
    return payment.join(expense.select("expense_id", "group_id"), "expense_id").join(member, ["group_id", "person_id"], "left_anti").select("expense_id", "person_id")


def missing_reference(df: DataFrame, target: DataFrame, column: str, target_column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` names nothing in ``target``; NULL names nothing and
    needs nothing, so it passes."""
    live = target.select(F.col(target_column).alias(column))
    return df.where(F.col(column).isNotNull()).join(live, column, "left_anti")


def receipts_held_twice(expense: DataFrame) -> DataFrame:
    """(receipt_id, held): receipts that more than one live expense holds. ``expense``:
    (expense_id, receipt_id), live ones."""
    return expense.where("receipt_id IS NOT NULL").groupBy("receipt_id").agg(F.countDistinct("expense_id").alias("held")).where("held > 1")


def valid_digits(kind: Column, digits: Column) -> Column:
    d = blank_to_null(digits)
    return d.isNull() | ((kind == "card") & d.rlike("^[0-9]{4}$"))


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def account_terms(method: DataFrame) -> DataFrame:
    """(method_id, rule, fixed_minor): a fee of zero becomes NULL."""
    fee = F.coalesce("fixed_minor", F.lit(0))
    rules = [
        ("cash_currency", (F.col("kind") == "cash") & F.col("fixed_currency").isNotNull()), ("fees_only_on_cards", (F.col("kind") != "card") & ((F.coalesce("foreign_percent", F.lit(0)) != 0) | (fee != 0))),
        ("percent", ~F.coalesce("foreign_percent", F.lit(0)).between(0, 100)), ("fee", fee < 0),
    ]
    return method.select("method_id", first_broken(rules).alias("rule"), F.nullif(fee, F.lit(0)).alias("fixed_minor"))


def stored_split(share: DataFrame, expense: DataFrame) -> DataFrame:
    """Shares whose filled columns don't fit the mode of their expense."""
    df = share.join(expense.select("expense_id", "split_mode"), "expense_id")
    want = F.create_map(F.lit("weights"), F.lit("weight"), F.lit("percent"), F.lit("percent"), F.lit("exact"), F.lit("amount"))[F.col("split_mode")]
    have = F.concat_ws("+", F.when(F.col("weight").isNotNull(), "weight"), F.when(F.col("percent").isNotNull(), "percent"), F.when(F.col("amount_minor").isNotNull(), "amount"))
    return df.where(~have.eqNullSafe(F.coalesce(want, F.lit("")))).select("expense_id", "person_id")


def own_rate(df: DataFrame) -> DataFrame:
    """``df(id, currency, base, rate_from, rate_to)`` with ``use``: the own rate as typed,
    inverted, needless, or rejected."""
    c, b = F.col("currency"), F.col("base")
    use = F.when(c == b, "needless").when((F.col("rate_from") == c) & (F.col("rate_to") == b), "as_typed").when((F.col("rate_from") == b) & (F.col("rate_to") == c), "inverted").otherwise("rejected")
    return df.withColumn("use", use)
