"""Cash ledger: movements and cash payments, balances at an instant, counts, valuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import convert


def cash_balances(movement: DataFrame) -> DataFrame:
    """Per person and currency; balances of zero stay."""
    return movement.groupBy("person_id", "currency").agg(F.sum("amount_minor").alias("balance"))


def ledger(movement: DataFrame, payment: DataFrame) -> DataFrame:
    """Stored movements, and payments by cash methods as negatives. ``payment``: (id,
    person_id, currency, amount_minor, occurred_ts)."""
    paid = payment.select("id", "person_id", "currency", F.lit("payment").alias("kind"), (-F.col("amount_minor")).alias("amount_minor"), "occurred_ts")
    return movement.select("id", "person_id", "currency", "kind", "amount_minor", "occurred_ts").unionByName(paid)


def running_balance(entries: DataFrame) -> DataFrame:
    """Add ``balance``: the sum of all entries at or before the entry's instant."""
    w = Window.partitionBy("person_id", "currency").orderBy("occurred_ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("balance", F.sum("amount_minor").over(w))


def count_corrections(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(count_id, expected, correction) for ``counts(count_id, person_id, currency, counted,
    occurred_ts)``: counted less expected at that instant, NULL when they agree. Counts
    below zero are refused and left out.

    Counts join the ledger as entries of zero, so one running sum serves all of them.
    """
    good = counts.where("counted >= 0")
    zero = F.lit(0).cast("bigint")
    both = entries.select("person_id", "currency", "amount_minor", "occurred_ts", F.lit(None).cast("bigint").alias("count_id"), F.lit(None).cast("bigint").alias("counted")).unionByName(
        good.select("person_id", "currency", zero.alias("amount_minor"), "occurred_ts", F.col("count_id").cast("bigint").alias("count_id"), F.col("counted").cast("bigint").alias("counted"))
    )
    df = running_balance(both).where("count_id IS NOT NULL")
    return df.select("count_id", F.col("balance").alias("expected"), F.nullif(F.col("counted") - F.col("balance"), zero).alias("correction"))


def exchange_sides(exchange: DataFrame) -> DataFrame:
    """Two movements of each exchange: what was given, negative, and what was received; both
    name the implied rate."""
    sides = F.array(F.struct(F.col("given_currency").alias("currency"), (-F.col("given_minor")).alias("amount_minor")), F.struct(F.col("received_currency").alias("currency"), F.col("received_minor").alias("amount_minor")))
    return exchange.select("exchange_id", "person_id", F.concat(F.lit("rate-"), F.col("exchange_id").cast("string")).alias("fx_rate_id"), F.explode(sides).alias("s")).select("exchange_id", "person_id", "fx_rate_id", "s.currency", "s.amount_minor")


def withdrawals(withdrawal: DataFrame, fee_category: str = "fees") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movements, implied rates, fee expenses) of ``withdrawal(withdrawal_id, person_id,
    currency, amount_minor, charged_currency, charged_minor, fee_minor, method_id)``: the
    cash that came in; the rate of charge to cash, where the currencies differ; the fee as
    an expense of the owner alone."""
    rate_id = F.concat(F.lit("rate-"), F.col("withdrawal_id").cast("string"))
    foreign = F.col("currency") != F.col("charged_currency")
    moved = withdrawal.select("withdrawal_id", "person_id", "currency", "amount_minor", F.when(foreign, rate_id).alias("fx_rate_id"), "method_id")
    rates = withdrawal.where(foreign).select(rate_id.alias("id"), F.col("charged_currency").alias("base"), F.col("currency").alias("quote"), F.col("amount_minor").alias("num"), F.col("charged_minor").alias("den"))
    fees = withdrawal.where("fee_minor > 0").select("withdrawal_id", F.lit(fee_category).alias("category_id"), F.col("charged_currency").alias("currency"), F.col("fee_minor").alias("total_minor"), F.col("person_id").alias("payer"), "method_id")
    return moved, rates, fees


def counterpart(movement: DataFrame) -> DataFrame:
    """The other side of each exchange: same rate, another currency, as an amount above 0."""
    a, b = movement.alias("a"), movement.alias("b")
    hit = (F.col("a.fx_rate_id") == F.col("b.fx_rate_id")) & (F.col("a.currency") != F.col("b.currency"))
    return a.join(b, hit, "left").select("a.exchange_id", F.col("a.currency").alias("currency"), F.col("b.currency").alias("other_currency"), F.abs("b.amount_minor").alias("other_minor"))


def valuation(balance: DataFrame, latest: DataFrame, currency: DataFrame, home: str) -> DataFrame:
    """(person_id, value, missing): cash in the home currency at the latest rates, and the
    currencies without a rate."""
    exp = F.broadcast(currency.select("code", "exponent"))
    rate = latest.where(F.col("quote") == home).select(F.col("base").alias("currency"), "num", "den")
    df = balance.join(F.broadcast(rate), "currency", "left")  # one row per currency
    df = df.join(exp.toDF("currency", "eb"), "currency").crossJoin(exp.where(F.col("code") == home).select(F.col("exponent").alias("eq")))
    value = F.when(F.col("currency") == home, F.col("balance")).when(F.col("num").isNotNull(), convert(F.col("balance"), F.col("num"), F.col("den"), F.col("eb"), F.col("eq")))
    df = df.withColumn("v", value)
    return df.groupBy("person_id").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("v").isNull(), F.col("currency")))), ",").alias("missing"))


def cascade(movement: DataFrame, deleted: DataFrame) -> DataFrame:
    """All movements that go with the deleted ones: twins of one exchange."""
    return movement.join(movement.join(deleted, ["exchange_id", "currency"], "left_semi").select("fx_rate_id").distinct(), "fx_rate_id", "left_semi")
