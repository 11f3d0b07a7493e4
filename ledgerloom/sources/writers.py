"""Writers: the rate archive, wide CSV per group, settlement reports."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import amount_text, money_text

BOM = "﻿"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a session of one machine
    that has none takes a folder of its own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def archive_rates(rates: DataFrame, path: str, source: str, fetched_at_ms: int) -> None:
    """Append one fetch; earlier fetches stay. A fetch that is already there is not written
    twice."""
    df = rates.select(F.concat_ws("-", F.lit(source), F.lit(fetched_at_ms).cast("string"), "base", "quote", F.col("rate_date").cast("string")).alias("id"), "base", "quote", "rate", "rate_date", F.lit(fetched_at_ms).cast("bigint").alias("fetched_at"), F.lit(source).alias("source"))
    df = df.dropDuplicates(["id"])
    spark = rates.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        there = spark.read.parquet(path).where((F.col("source") == source) & (F.col("fetched_at") == fetched_at_ms))
        df = df.join(there.select("id"), "id", "left_anti").select(*df.columns)
    df.write.mode("append").partitionBy("rate_date").parquet(path)


def text_cell(text: Column) -> Column:
    """A cell that no spreadsheet runs as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(F.coalesce(text, F.lit("")))


def quoted(cell: Column, separator: str = ";") -> Column:
    return F.when(cell.rlike(f'[{separator}"\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(cell, '"', '""'), F.lit('"'))).otherwise(cell)


def date_time(occurred_at: Column) -> Column:
    return F.concat(F.substring(occurred_at, 1, 10), F.lit(" "), F.substring(occurred_at, 12, 5))


def file_name(name: Column, today: str) -> Column:
    safe = F.regexp_replace(F.trim(F.regexp_replace(name, r'[\p{Cntrl}/\\:*?"<>|]', "_")), r"^\.+|\.+$", "")
    return F.concat(F.when(safe == "", "expenses").otherwise(safe), F.lit(f" {today}.csv"))


def group_lines(expense: DataFrame, items: DataFrame, shares: DataFrame, payments: DataFrame, member: DataFrame, exponent: int = 2, separator: str = ";", mark: str = ",") -> DataFrame:
    """(group_id, line_no, line): a header, then each expense followed by its items; two
    columns (paid, share) per person, members first, then others.

    The people of a group differ and few of them take part in an expense, so a line is built
    from the cells that say something, with as many separators between them as there are
    columns to pass; lines are numbered before they have their text.
    """
    involved = payments.select("group_id", "person_id").unionByName(shares.select("group_id", "person_id")).distinct()
    people = involved.join(member.select("group_id", "person_id", "idx"), ["group_id", "person_id"], "full_outer")
    people = people.withColumn("col_no", F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("idx").asc_nulls_last(), "person_id")))
    width = people.groupBy("group_id").agg(F.count("*").cast("int").alias("__width"))
    amount = lambda c: F.coalesce(amount_text(F.col(c), F.lit(exponent), mark), F.lit(""))
    facts = payments.select("group_id", "expense_id", "person_id", F.col("base_minor").alias("paid"), F.lit(None).cast("bigint").alias("share")).unionByName(shares.select("group_id", "expense_id", "person_id", F.lit(None).cast("bigint").alias("paid"), F.col("base_minor").alias("share")))
    facts = facts.groupBy("group_id", "expense_id", "person_id").agg(F.sum("paid").alias("paid"), F.sum("share").alias("share"))
    placed = facts.join(people.select("group_id", "person_id", "col_no"), ["group_id", "person_id"])
    said = placed.groupBy("group_id", "expense_id").agg(F.array_sort(F.collect_list(F.struct("col_no", amount("paid").alias("p"), amount("share").alias("s")))).alias("said"))
    rows = expense.join(width, "group_id").join(said, ["group_id", "expense_id"], "left").select("group_id", "occurred_date", "expense_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("position"), "occurred_at", "category_id", F.col("total_base_minor").alias("minor"), "__width", "said")
    lines = items.join(expense.select("group_id", "occurred_date", "expense_id"), "expense_id").select("group_id", "occurred_date", "expense_id", F.lit(1).alias("kind"), F.col("position").cast("bigint").alias("position"), "text", F.col("total_minor").alias("minor"))
    body = rows.unionByName(lines, allowMissingColumns=True).withColumn("line_no", F.row_number().over(Window.partitionBy("group_id").orderBy("occurred_date", "expense_id", "kind", "position")))

    def passed(x: Column, i: Column) -> Column:
        before = F.get("said", i - 1)["col_no"]
        return F.concat(F.repeat(F.lit(separator), F.when(i == 0, 2 * (x["col_no"] - 1)).otherwise(2 * (x["col_no"] - before) - 1)), x["p"], F.lit(separator), x["s"])

    last = F.get("said", F.size("said") - 1)["col_no"]
    cells = F.when(F.col("said").isNull(), F.repeat(F.lit(separator), 2 * F.col("__width") - 1)).otherwise(F.concat(F.array_join(F.transform("said", passed), ""), F.repeat(F.lit(separator), 2 * (F.col("__width") - last))))
    cell = lambda c: quoted(text_cell(c), separator)
    spent = F.concat_ws(separator, F.lit("expense"), date_time(F.col("occurred_at")), cell(F.coalesce("category_id", F.lit(""))), amount("minor"), cells)
    item = F.concat_ws(separator, F.lit("item"), F.lit(""), cell(F.col("text")), amount("minor"))
    head = people.groupBy("group_id").agg(F.concat(F.lit(BOM), F.array_join(F.concat(F.array(*[F.lit(h) for h in ("type", "date", "category", "total")]), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "person_id"))), lambda x: F.array(F.concat(x["person_id"], F.lit(" paid")), F.concat(x["person_id"], F.lit(" share")))))), separator)).alias("line"))
    return body.select("group_id", "line_no", F.when(F.col("kind") == 0, spent).otherwise(item).alias("line")).unionByName(head.select("group_id", F.lit(0).alias("line_no"), "line"))


def write_group_csv(lines: DataFrame, path: str) -> None:
    """One folder per group; lines end with CR LF."""
    lines.repartition("group_id").sortWithinPartitions("group_id", "line_no").select("group_id", "line").write.partitionBy("group_id").text(path, lineSep="\r\n")


def settlement_report(totals: DataFrame, debts: DataFrame, exponent: int = 2, symbol: str = "€") -> DataFrame:
    """(group_id, report): heading, total, a blank line, one line per transfer."""
    text = F.concat("from_person", F.lit(" -> "), "to_person", F.lit(": "), money_text(F.col("amount_minor"), F.lit(exponent), F.lit(symbol)))
    lines = debts.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    head = F.concat(F.lit("Group "), F.col("group_id").cast("string"), F.lit("\nTotal "), money_text(F.col("total"), F.lit(exponent), F.lit(symbol)), F.lit("\n\n"))
    return totals.join(lines, "group_id", "left").select("group_id", F.concat(head, F.coalesce("lines", F.lit("all settled"))).alias("report"))
