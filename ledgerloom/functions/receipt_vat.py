"""VAT that a receipt states as contained in its prices: rates and amounts of its tax rows.

``rows``: (receipt_id, row_no, text) of tax rows. Odd input: a row without an amount, or with
a base alone, says nothing; null text is empty; ties go to the first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .receipt_lines import _of
from .receipt_text import bound, keyword, price, words

# Words that decide what a row means.
BASES = ("netto", "brutto", "umsatz", "net", "gross")
TAXES = ("mwst", "ust", "vat", "tax", "steuer", "tva", "iva")
NO_AMOUNT = ("対象", "小計")


def rate_of(tokens: Column) -> Column:
    """The first rate above 0 and below 100: 19%, 1=19,00%, 7 %."""

    def one(token: Column, i: Column) -> Column:
        spelled = F.when(token.startswith("%"), F.when(i > 0, _of(tokens, i - 1))).otherwise(F.regexp_extract(token, "^([^%]*)%", 1))
        value = F.regexp_replace(F.regexp_extract(spelled, "([0-9.,]+)$", 1), ",", ".").try_cast("decimal(12,6)")
        return F.when(token.contains("%"), bound(value, lambda v: F.when((v > 0) & (v < 100), v)))

    return _of(F.filter(F.transform(tokens, one), lambda v: v.isNotNull()), 0)


def vat_amount(text: Column, exponent: int) -> Column:
    """The tax of a row: its only amount where the row names a tax, the smaller of two, of more
    the smallest that makes another amount a third."""

    def of(t: Column) -> Column:
        is_rate = lambda x, i: x.contains("%") | F.coalesce(_of(t, i + 1).startswith("%"), F.lit(False))
        found = F.filter(F.transform(t, lambda x, i: F.when(~is_rate(x, i), price(F.regexp_replace(x, "^[()（）]+|[()（）]+$", ""), exponent))), lambda m: m > 0)
        named = F.exists(t, lambda x: keyword(x).rlike("|".join(TAXES))) | text.contains("税")
        base = F.coalesce(keyword(_of(t, 0)).isin(*BASES), F.lit(True))

        def tax(m: Column) -> Column:
            completes = lambda v: F.exists(m, lambda net: (net != v) & F.exists(m, lambda gross: net + v == gross))
            single = F.when(named & ~text.contains(NO_AMOUNT[0]) & ~text.contains(NO_AMOUNT[1]), _of(m, 0))
            return F.when(F.size(m) == 1, single).when(F.size(m) == 2, F.array_min(m)).when(F.size(m) > 2, F.array_min(F.filter(m, completes)))

        return F.when(~base, bound(found, tax))

    return bound(words(text), of)


def vat_lines(rows: DataFrame, totals: DataFrame, added: DataFrame, exponent: int) -> DataFrame:
    """(receipt_id, rate, amount): each rate and amount once; an amount without a rate only
    where none with that amount has one; less than the total of totals(receipt_id, total), and
    neither one of added(receipt_id, amount), the tax paid on top, nor all of it."""
    text = F.coalesce("text", F.lit(""))
    said = rows.select("receipt_id", "row_no", rate_of(words(text)).alias("rate"), vat_amount(text, exponent).alias("amount"))
    # rows without an amount go after they are counted: a filter before would read each row twice
    once = said.groupBy("receipt_id", "amount", "rate").agg(F.min("row_no").alias("row_no"), F.count("amount").alias("__n")).where("__n > 0").drop("__n")
    rated = F.max(F.col("rate").isNotNull()).over(Window.partitionBy("receipt_id", "amount"))
    kept = once.withColumn("__rated", rated).where("rate IS NOT NULL OR NOT __rated")
    small = kept.join(totals.select("receipt_id", "total"), "receipt_id", "left").where("total IS NULL OR amount < total")
    on_top = added.select("receipt_id", "amount").unionByName(added.groupBy("receipt_id").agg(F.sum("amount").alias("amount"))).distinct()
    return small.join(on_top, ["receipt_id", "amount"], "left_anti").select("receipt_id", "row_no", "rate", "amount")
