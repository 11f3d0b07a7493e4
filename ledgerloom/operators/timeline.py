"""Timelines: one table of expenses and settlements, filters, search, order, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_date(occurred_at: Column) -> Column:
    return F.substring(occurred_at, 1, 10).cast("date")


def local_time(occurred_at: Column) -> Column:
    return F.substring(occurred_at, 12, 8)


def instant(occurred_at: Column) -> Column:
    return F.to_timestamp(occurred_at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def timeline(expense: DataFrame, settlement: DataFrame) -> DataFrame:
    """item_type, item_id, group_id, local_day, local_time, category_id, people, texts and
    amounts of both kinds of item. ``expense`` has people and texts as arrays."""
    e = expense.select(F.lit("expense").alias("item_type"), F.col("expense_id").alias("item_id"), "group_id", "occurred_at", "category_id", "people", "texts", "total_minor", "currency")
    s = settlement.select(F.lit("settlement").alias("item_type"), F.col("settlement_id").alias("item_id"), "group_id", "occurred_at", F.lit(None).cast("string").alias("category_id"), F.array("from_person", "to_person").alias("people"), F.array().cast("array<string>").alias("texts"), F.col("amount_minor").alias("total_minor"), "currency")
    both = e.unionByName(s)
    return both.withColumn("local_day", local_date(F.col("occurred_at"))).withColumn("local_time", local_time(F.col("occurred_at")))


def ordered(items: DataFrame, group: list[str]) -> DataFrame:
    """Add ``line``: local day and second, newest first; at the same second expenses before
    settlements; then the newer id."""
    order = [F.desc("local_day"), F.desc("local_time"), F.when(F.col("item_type") == "expense", 0).otherwise(1), F.desc("item_id")]
    return items.withColumn("line", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def facet_filter(people: list[str] | None = None, categories: list[str] | None = None, methods: list[str] | None = None, first: str | None = None, last: str | None = None, receipt: bool | None = None) -> Column:
    """Any value within a facet, all facets together; settlements have no category, method
    of their own or receipt, so those facets drop them. Facets that aren't set add nothing."""
    keep = F.lit(True)
    expense = F.col("item_type") == "expense"
    if people:
        keep &= F.arrays_overlap("people", F.array(*[F.lit(p) for p in people]))
    if categories:
        keep &= expense & F.col("category_id").isin(categories)
    if methods:
        keep &= F.arrays_overlap("methods", F.array(*[F.lit(m) for m in methods]))
    if receipt is not None:
        keep &= expense & (F.col("has_receipt") == receipt)
    if first:
        keep &= F.col("local_day") >= F.lit(first).cast("date")
    if last:
        keep &= F.col("local_day") <= F.lit(last).cast("date")
    return F.coalesce(keep, F.lit(False))


def text_search(query: str) -> Column:
    """Case-insensitive substring of any of ``texts``; a blank query matches all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.exists("texts", lambda t: F.lower(t).contains(q)), F.lit(False))


def day_heading(day: Column, today: Column) -> Column:
    names = F.array(*[F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return F.when(day == today, "today").when(day == F.date_sub(today, 1), "yesterday").otherwise(F.concat(F.element_at(names, F.weekday(day) + 1), F.lit(" "), day.cast("string")))


def first_days(items: DataFrame, group: list[str], days: int = 20) -> DataFrame:
    """The items of the newest ``days`` days of each group."""
    return items.withColumn("__d", F.dense_rank().over(Window.partitionBy(*group).orderBy(F.desc("local_day")))).where(F.col("__d") <= days).drop("__d")


def payers_text(payment: DataFrame, person: DataFrame, method: DataFrame) -> DataFrame:
    """(expense_id, payers): "Anna (Visa), Ben" in person order; deleted names stay."""
    named = payment.join(person.select("person_id", "name"), "person_id", "left").join(method.select(F.col("method_id").alias("payment_method_id"), F.col("name").alias("method")), "payment_method_id", "left")
    text = F.concat("name", F.when(F.col("method").isNotNull(), F.concat(F.lit(" ("), "method", F.lit(")"))).otherwise(""))
    return named.groupBy("expense_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("person_id", text.alias("t")))), lambda x: x["t"]), ", ").alias("payers"))


def receipt_archive(receipt: DataFrame, expense: DataFrame, query: str = "") -> DataFrame:
    """Receipts with the earliest live expense that holds them; ``query`` is looked for in
    merchant, title and recognised text, a blank one matches all."""
    w = Window.partitionBy("receipt_id").orderBy("created_at", "expense_id")
    first = expense.where("receipt_id IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("receipt_id", "expense_id", "title")
    df = receipt.join(first, "receipt_id", "left")
    q = query.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in ("merchant", "title", "raw_text"):
        hit |= F.coalesce(F.lower(c).contains(q), F.lit(False))
    return df.where(hit)
