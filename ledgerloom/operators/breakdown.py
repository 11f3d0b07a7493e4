"""Breakdowns, shares of a total, day totals, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakdown(facts: DataFrame, group: list[str], key: list[str], amount: str) -> DataFrame:
    """amount and count per group and key, with ``rank``: largest first, ties by key, NULL
    first; and ``total``, the group's."""
    out = facts.groupBy(*group, *key).agg(F.sum(amount).alias("amount"), F.count("*").alias("n"))
    w = Window.partitionBy(*group)
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("amount"), *[F.col(k).asc_nulls_first() for k in key]))).withColumn("total", F.sum("amount").over(w))


def regroup(slices: DataFrame, group: list[str], mapped: Column, name: str, order: Column) -> DataFrame:
    """Slices under a coarser key; the total is unchanged. Ties by ``order``."""
    out = slices.withColumn(name, mapped).groupBy(*group, name).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("amount"), order)))


def part_of_total(amount: Column, total: Column) -> Column:
    """Thousandths, rounded down."""
    return F.when(total > 0, ((amount * 1000 - (amount * 1000) % total) / total).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def percent_text(thousandths: Column) -> Column:
    return F.when((thousandths > 0) & (thousandths < 10), "< 1 %").otherwise(F.concat(((thousandths + 5 - (thousandths + 5) % 10) / 10).cast("bigint").cast("string"), F.lit(" %")))


def arcs(slices: DataFrame, group: list[str]) -> DataFrame:
    """Add ``start`` and ``stop`` in thousandths of a ring that closes exactly."""
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    end = part_of_total(F.sum("amount").over(w), F.col("total"))
    df = slices.withColumn("stop", end)
    return df.withColumn("start", F.coalesce(F.lag("stop").over(Window.partitionBy(*group).orderBy("rank")), F.lit(0)))


def unique_winner(votes: DataFrame, group: list[str], choice: str, count: str) -> DataFrame:
    """The choice with the most votes of each group; none where two share the lead."""
    ranked = votes.withColumn("__d", F.dense_rank().over(Window.partitionBy(*group).orderBy(F.desc(count)))).where("__d = 1")
    return ranked.groupBy(*group).agg(F.when(F.count("*") == 1, F.min(choice)).alias(choice))


def least_used(palette: DataFrame, used: DataFrame, color: str) -> DataFrame:
    """The palette colour used least; ties by place in the palette. One row."""
    n = used.groupBy(color).agg(F.count("*").alias("n"))
    joined = palette.join(n, color, "left")
    return joined.agg(F.min_by(color, F.struct(F.coalesce("n", F.lit(0)), "place")).alias(color))
