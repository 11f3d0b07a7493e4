"""Payment methods: who may use which, what a receipt's payment suggests, statements.

``method``: (method_id, kind, name, owner, archived, deleted); ``owner`` is a person, or NULL
for a method that is everybody's. ``person``: (person_id, name, is_me, deleted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import RATE_SCALE, convert, rate_num
from .numbering import lines_by_bucket, lines_of_all


def visible(method: DataFrame, person: DataFrame) -> DataFrame:
    """Methods that lists show: not deleted, and everybody's or a live person's."""
    live = person.where("NOT deleted").select(F.col("person_id").alias("owner"))
    there = method.where("NOT deleted")
    return there.where("owner IS NULL").unionByName(there.where("owner IS NOT NULL").join(live, "owner", "left_semi").select(*there.columns))


def own_methods(method: DataFrame, person: DataFrame) -> DataFrame:
    """(owner, method_id, name) of every person's own methods that are not archived."""
    return visible(method, person).where("owner IS NOT NULL AND NOT archived").select("owner", "method_id", "name")


def withdrawal_cards(method: DataFrame, person: DataFrame) -> DataFrame:
    """(owner, method_id) that cash can be taken out with: not archived, no cash. Rows without
    an owner are everybody's; they stay one row each and are not repeated for each person."""
    return visible(method, person).where("NOT archived AND kind <> 'cash'").select("owner", "method_id")


def fits_owner(choice: DataFrame, usable: DataFrame) -> DataFrame:
    """``choice(person_id, method_id, ...)`` with ``fits``: the method is among ``usable(owner,
    method_id)`` and is the person's own or everybody's."""
    named = usable.select("method_id", F.col("owner").alias("__owner"), F.lit(True).alias("__there"))
    own = F.col("__there") & (F.col("__owner").isNull() | (F.col("__owner") == F.col("person_id")))
    return choice.join(named, "method_id", "left").withColumn("fits", F.coalesce(own, F.lit(False))).drop("__owner", "__there")


def all_methods(method: DataFrame, person: DataFrame) -> DataFrame:
    """Visible methods with ``line``: by owner (me first, then by name; everybody's last),
    active before archived, by name."""
    who = person.select(F.col("person_id").alias("owner"), F.col("name").alias("owner_name"), "is_me")
    df = visible(method, person).join(who, "owner", "left")
    order = [F.col("owner").isNull(), ~F.coalesce("is_me", F.lit(False)), F.lower("owner_name"), F.col("owner"), F.col("archived"), F.lower("name"), F.col("method_id")]
    return lines_of_all(df, order)


def method_for_payment(wanted: DataFrame, usable: DataFrame, last: DataFrame) -> DataFrame:
    """``wanted(person_id, payment, current, ...)`` with ``method``: of the usable methods that
    are ``payment`` (cash or card), the current one, else the person's last one, else the
    person's first by name, else everybody's first; NULL if there is none.

    ``usable``: (method_id, kind, name, owner); ``last``: (person_id, last).
    """
    fitting = usable.select("method_id", F.col("kind").alias("__kind"), "owner")
    by_name = F.min_by("method_id", F.struct(F.lower("name"), F.col("method_id")))
    first = usable.groupBy("owner", "kind").agg(by_name.alias("__m"))
    own = first.where("owner IS NOT NULL").select(F.col("owner").alias("person_id"), F.col("kind").alias("payment"), F.col("__m").alias("__own"))
    anyone = first.where("owner IS NULL").select(F.col("kind").alias("payment"), F.col("__m").alias("__any"))  # a row per kind
    df = wanted.join(last.withColumnRenamed("last", "__last"), "person_id", "left")
    for c, name in (("current", "__current"), ("__last", "__former")):
        m = fitting.select(F.col("method_id").alias(c), F.col("__kind").alias(f"{name}_kind"), F.col("owner").alias(f"{name}_owner"))
        df = df.join(m, c, "left")
        fits = (F.col(f"{name}_kind") == F.col("payment")) & (F.col(f"{name}_owner").isNull() | (F.col(f"{name}_owner") == F.col("person_id")))
        df = df.withColumn(name, F.when(fits, F.col(c))).drop(f"{name}_kind", f"{name}_owner")
    df = df.join(own, ["person_id", "payment"], "left").join(anyone, "payment", "left")
    return df.withColumn("method", F.coalesce("__current", "__former", "__own", "__any")).drop("__last", "__current", "__former", "__own", "__any")


def charged(withdrawal: DataFrame, archive: DataFrame, currency: DataFrame) -> DataFrame:
    """``withdrawal(currency, amount_minor, fx_rate_id, ...)`` with charged_minor and
    charged_currency: the cash at the rate archived with it, read in the direction that has
    the cash's currency; the cash itself where there is no rate or it is of other currencies."""
    exp = F.broadcast(currency.select("code", "exponent"))  # a fixed dimension
    rate = archive.select(F.col("id").alias("fx_rate_id"), "base", "quote", rate_num(F.col("rate")).alias("__n"))
    df = withdrawal.join(rate, "fx_rate_id", "left")
    there, back = F.col("base") == F.col("currency"), F.col("quote") == F.col("currency")
    scale = F.lit(RATE_SCALE).cast("decimal(20,0)")
    df = df.withColumn("__to", F.when(there, F.col("quote")).when(back, F.col("base"))).withColumn("__num", F.when(there, F.col("__n")).otherwise(scale)).withColumn("__den", F.when(there, scale).otherwise(F.col("__n")))
    df = df.join(exp.toDF("currency", "__eb"), "currency", "left").join(exp.toDF("__to", "__eq"), "__to", "left")
    known = F.col("__to").isNotNull() & F.col("__n").isNotNull() & F.col("__eb").isNotNull() & F.col("__eq").isNotNull()
    amount = F.when(known, convert(F.col("amount_minor"), F.col("__num"), F.col("__den"), F.col("__eb"), F.col("__eq"))).otherwise(F.col("amount_minor"))
    return df.withColumn("charged_minor", amount).withColumn("charged_currency", F.when(known, F.col("__to")).otherwise(F.col("currency"))).drop("base", "quote", "__n", "__to", "__num", "__den", "__eb", "__eq")


def statement(payment: DataFrame, withdrawal: DataFrame, archive: DataFrame, currency: DataFrame) -> DataFrame:
    """Everything paid with each method, with ``line``: latest first, at one instant parts of
    expenses before withdrawals, then the newer id. The amount of a withdrawal is what was
    charged (:func:`charged`).

    ``payment``: (payment_method_id, expense_id, person_id, amount_minor, currency, at);
    ``withdrawal``: (payment_method_id, id, person_id, currency, amount_minor, fx_rate_id, at).
    Lines are numbered hour by hour, so a method of many rows is no one task's work.
    """
    parts = payment.where("payment_method_id IS NOT NULL").select("payment_method_id", F.lit("expense").alias("source"), F.col("expense_id").alias("source_id"), "person_id", "amount_minor", "currency", "at")
    cash = charged(withdrawal.where("payment_method_id IS NOT NULL"), archive, currency)
    cash = cash.select("payment_method_id", F.lit("withdrawal").alias("source"), F.col("id").alias("source_id"), "person_id", F.col("charged_minor").alias("amount_minor"), F.col("charged_currency").alias("currency"), "at")
    hour: Column = -F.floor(F.unix_seconds("at") / 3600)
    return lines_by_bucket(parts.unionByName(cash), ["payment_method_id"], hour, [F.desc("at"), F.col("source"), F.desc("source_id"), F.desc("person_id")])
