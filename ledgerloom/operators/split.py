"""Splitting: largest-remainder allocation, the five split modes, itemised splits.

All expenses at once. The windows of one allocation share one partitioning, so each
allocation costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights have six decimals.
WEIGHT_SCALE = 10**6
#: Two whole numbers up to this have a product that fits a bigint.
NARROW = 3_037_000_499


def allocate(df: DataFrame, group: list[str], total: Column, weight: Column, tie: list[str], out: str = "share_minor", whole: bool = False) -> DataFrame:
    """Add ``out``: parts of ``total`` in proportion to ``weight`` that sum to it exactly.

    |total| * w / sum(w) is cut to whole units; the units left go one each to the largest
    remainders, ties by ``tie``. The sign of the total comes back at the end; weights of
    zero get 0; a group whose weights are all zero gets NULL. ``whole``: weights are amounts
    of minor units, which need no decimals. Products that fit a bigint are made as such.
    """
    w = Window.partitionBy(*group)
    # a remainder is below the sum of weights
    kind = "bigint" if whole else "decimal(38,0)"
    weighed = weight.cast("bigint") if whole else F.floor(weight.cast("decimal(18,6)") * WEIGHT_SCALE).cast("decimal(18,0)")
    df = df.withColumn("__t", total.cast("bigint")).withColumn("__w", weighed)
    df = df.withColumn("__sum", F.sum("__w").over(w))
    some = F.when(F.col("__sum") > 0, F.col("__sum"))
    small = F.col("__t").between(-NARROW, NARROW) & (F.col("__w") <= NARROW) & (F.col("__sum") <= 2**62)
    short = F.abs("__t") * F.col("__w").cast("bigint")
    long_ = (F.abs("__t").cast("decimal(19,0)") * F.col("__w").cast("decimal(19,0)")).cast("decimal(38,0)")
    df = df.withColumn("__rem", F.when(small, (short % some.cast("bigint")).cast(kind)).otherwise((long_ % some.cast("decimal(28,0)")).cast(kind)))
    base = F.when(small, F.call_function("div", short, some.cast("bigint"))).otherwise(((long_ - F.col("__rem").cast("decimal(38,0)")) / some.cast("decimal(28,0)")).cast("bigint"))
    df = df.withColumn("__base", base)
    left = F.abs(F.col("__t")) - F.sum("__base").over(w)
    turn = F.row_number().over(w.orderBy(F.col("__rem").desc(), *tie))
    share = F.signum("__t").cast("bigint") * (F.col("__base") + F.when(turn <= left, 1).otherwise(0))
    return df.withColumn(out, share).drop("__t", "__w", "__sum", "__rem", "__base")


def rescale(parts: DataFrame, group: list[str], target: Column, part: Column, tie: list[str], out: str = "base_minor") -> DataFrame:
    """Parts scaled to sum to ``target``. Groups whose parts have both signs get NULL: they
    have no proportions and belong to the rejects."""
    w = Window.partitionBy(*group)
    df = allocate(parts.withColumn("__p", part.cast("bigint")), group, target, F.abs(F.col("__p")), tie, out, whole=True)
    mixed = (F.min("__p").over(w) < 0) & (F.max("__p").over(w) > 0)
    return df.withColumn(out, F.when(~mixed, F.col(out))).drop("__p")


def by_mode(expense: DataFrame, share: DataFrame) -> DataFrame:
    """(expense_id, person_id, share_minor) for the modes equal, weights, percent, exact."""
    df = share.join(expense.where("split_mode <> 'items'").select("expense_id", "split_mode", "total_minor"), "expense_id")
    weight = F.when(F.col("split_mode") == "weights", F.col("weight")).when(F.col("split_mode") == "percent", F.col("percent")).otherwise(F.lit(1))
    df = allocate(df, ["expense_id"], F.col("total_minor"), weight, ["person_id"])
    return df.select("expense_id", "person_id", F.when(F.col("split_mode") == "exact", F.col("amount_minor")).otherwise(F.col("share_minor")).alias("share_minor"))


def assignable(items: DataFrame) -> DataFrame:
    """Lines that a person can hold: articles, discounts, deposits."""
    return items.where(F.col("kind").isin("article", "discount", "deposit"))


def effective_owner(items: DataFrame) -> DataFrame:
    """Add ``owner``: the position of the nearest line at or above that stands alone. An
    attached first line owns itself and the attached lines below it."""
    w = Window.partitionBy("expense_id").orderBy("position")
    alone = F.last(F.when(~F.col("attached"), F.col("position")), ignorenulls=True).over(w)
    return items.withColumn("owner", F.coalesce(alone, F.first("position").over(w)))


def itemised(expense: DataFrame, items: DataFrame, assignment: DataFrame, participant: DataFrame) -> DataFrame:
    """(expense_id, person_id, share_minor) of expenses split by items.

    Lines with the same holders and weights are pooled before they are rounded; lines
    that nobody holds belong to the participants by default weight; what the lines don't
    explain follows the positive shares so far, else the default weights.
    """
    totals = expense.where("split_mode = 'items'").select("expense_id", F.col("total_minor").alias("total"))
    # other expenses go before the windows and lists, not after them
    items, assignment, participant = (df.join(totals, "expense_id", "left_semi") for df in (items, assignment, participant))
    lines = effective_owner(assignable(items)).select("expense_id", "owner", F.col("total_minor").alias("line"))
    entry = F.struct("person_id", F.col("weight").cast("decimal(12,6)").alias("weight"))
    held = assignment.groupBy("expense_id", F.col("position").alias("owner")).agg(F.array_sort(F.collect_list(entry)).alias("own"))
    people = participant.groupBy("expense_id").agg(F.array_sort(F.collect_list(entry)).alias("everyone"))
    pooled = (
        lines.join(held, ["expense_id", "owner"], "left").join(people, "expense_id")
        .groupBy("expense_id", F.coalesce("own", "everyone").alias("holders")).agg(F.sum("line").alias("pool"))
    )
    spread = pooled.select("expense_id", "holders", "pool", F.explode("holders").alias("h")).select("expense_id", "holders", "pool", "h.person_id", "h.weight")
    parts = allocate(spread, ["expense_id", "holders"], F.col("pool"), F.col("weight"), ["person_id"], "part")
    everyone = parts.select("expense_id", "person_id", "part", F.lit(None).cast("decimal(12,6)").alias("default")).unionByName(
        participant.select("expense_id", "person_id", F.lit(0).cast("bigint").alias("part"), F.col("weight").cast("decimal(12,6)").alias("default"))
    )
    sofar = everyone.groupBy("expense_id", "person_id").agg(F.sum("part").alias("sofar"), F.max("default").alias("default")).join(totals, "expense_id")
    w = Window.partitionBy("expense_id")
    sofar = sofar.withColumn("rest", F.col("total") - F.sum("sofar").over(w)).withColumn("top", F.max("sofar").over(w))
    weight = F.when(F.col("top") > 0, F.greatest("sofar", F.lit(0)).cast("decimal(18,6)")).otherwise(F.coalesce("default", F.lit(0)))
    done = allocate(sofar, ["expense_id"], F.col("rest"), weight, ["person_id"], "extra")
    return done.select("expense_id", "person_id", (F.col("sofar") + F.coalesce("extra", F.lit(0))).alias("share_minor"))


def shares(expense: DataFrame, share: DataFrame, items: DataFrame, assignment: DataFrame, participant: DataFrame) -> DataFrame:
    """Shares of all expenses in their own currency."""
    return by_mode(expense, share).unionByName(itemised(expense, items, assignment, participant))


def in_base(parts: DataFrame, expense: DataFrame, amount: str) -> DataFrame:
    """Add ``base_minor``: ``parts`` rescaled to ``total_base_minor`` of their expense."""
    df = parts.join(expense.select("expense_id", "total_base_minor"), "expense_id")
    key = [c for c in ("person_id", "payment_method_id") if c in parts.columns]
    return rescale(df, ["expense_id"], F.col("total_base_minor"), F.col(amount), key).drop("total_base_minor")


def parts_in_base(shares: DataFrame, payment: DataFrame, expense: DataFrame, columns: tuple[str, ...] = ("group_id",), tasks: int = 0) -> DataFrame:
    """What everybody consumed and paid, in one pass: (expense_id, person_id,
    payment_method_id, kind, base_minor and ``columns`` of the expense), ``kind`` being
    ``consumed`` or ``paid``.

    Expenses whose shares have both signs, or are all zero, have no proportions and are left
    out. All windows lie on the partitioning that the join with ``expense`` needs, which has
    ``tasks`` parts if that is more than 0, so that what a task sorts fits its memory.
    """
    kinds = shares.select("expense_id", "person_id", F.lit(None).cast("string").alias("payment_method_id"), F.lit("consumed").alias("kind"), F.col("share_minor").cast("bigint").alias("__amount")).unionByName(
        payment.select("expense_id", "person_id", "payment_method_id", F.lit("paid").alias("kind"), F.col("amount_minor").cast("bigint").alias("__amount")))
    kinds = kinds.repartition(tasks, "expense_id") if tasks else kinds
    df = kinds.join(expense.select("expense_id", "total_base_minor", *columns), "expense_id")
    w = Window.partitionBy("expense_id")
    share = F.when(F.col("kind") == "consumed", F.col("__amount"))
    df = df.withColumn("__low", F.min(share).over(w)).withColumn("__high", F.max(share).over(w))
    none = ((F.col("__low") < 0) & (F.col("__high") > 0)) | ((F.col("__low") == 0) & (F.col("__high") == 0))
    good = df.where(~F.coalesce(none, F.lit(False))).drop("__low", "__high")
    out = rescale(good, ["expense_id", "kind"], F.col("total_base_minor"), F.col("__amount"), ["person_id", "payment_method_id"])
    return out.drop("__amount", "total_base_minor")


def split_line(items: DataFrame) -> DataFrame:
    """Each line in two: a whole quantity of 2 or more gives up one unit, others are halved.
    Lines under two units of money are refused and left out."""
    fit = items.where(F.abs("total_minor") >= 2)
    peel = (F.col("quantity") == F.floor("quantity")) & (F.col("quantity") >= 2)
    q = F.col("quantity").cast("decimal(12,6)")
    first = F.when(peel, q - 1).otherwise((q / 2).cast("decimal(12,6)"))
    second = F.when(peel, F.lit(1).cast("decimal(12,6)")).otherwise((q / 2).cast("decimal(12,6)"))
    # two parts need no window: the unit that is left, if any, goes to the larger remainder
    size = F.abs(F.col("total_minor").cast("bigint")).cast("decimal(19,0)")
    scaled = lambda x: F.floor(x.cast("decimal(18,6)") * WEIGHT_SCALE).cast("decimal(18,0)")
    one, two = (scaled(F.when(peel, x).otherwise(F.lit(1))) for x in (first, second))
    split = [(size * x).cast("decimal(38,0)") for x in (one, two)]
    rest = [x % (one + two) for x in split]
    base = [((x - r) / (one + two)).cast("bigint") for x, r in zip(split, rest, strict=True)]
    fit = fit.withColumn("__rest", F.struct(rest[0].alias("a"), rest[1].alias("b"))).withColumn("__base", F.struct(base[0].alias("a"), base[1].alias("b")))
    left, up = size.cast("bigint") - F.col("__base.a") - F.col("__base.b"), F.col("__rest.a") >= F.col("__rest.b")
    sign = F.signum("total_minor").cast("bigint")
    halves = F.array(*[
        F.struct(F.lit(half).alias("half"), q.cast("decimal(12,6)").alias("half_quantity"), (sign * (b + F.when(gets, left).otherwise(0))).alias("half_minor"))
        for half, q, b, gets in ((1, first, F.col("__base.a"), up), (2, second, F.col("__base.b"), ~up))
    ])
    return fit.withColumn("h", F.explode(halves)).select("*", "h.*").drop("h", "__rest", "__base")


def merge_lines(items: DataFrame, group: list[str]) -> DataFrame:
    """One line per group: equal text and kind add their quantities; otherwise the texts are
    joined with " + " and the quantity is 1. Kinds: the common one, else article."""
    # one value is the least and the greatest: counts of distinct values would triple the rows
    both = F.when(F.col("text").isNotNull() & F.col("kind").isNotNull(), F.struct("text", "kind"))
    alike = F.min(both) == F.max(both)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    return items.groupBy(*group).agg(
        F.when(alike, F.min("text")).otherwise(F.array_join(texts, " + ")).alias("text"),
        F.when(alike, F.sum("quantity")).otherwise(F.lit(1)).cast("decimal(22,6)").alias("quantity"),
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("article").alias("kind"), F.sum("total_minor").alias("total_minor"),
    )


def items_difference(expense: DataFrame, items: DataFrame) -> DataFrame:
    """(expense_id, items_minor, difference): lines that count (all but ignored) against the total."""
    summed = items.where("kind <> 'ignored'").groupBy("expense_id").agg(F.sum("total_minor").alias("items_minor"))
    return expense.join(summed, "expense_id", "left").select("expense_id", F.coalesce("items_minor", F.lit(0)).alias("items_minor"), (F.col("total_minor") - F.coalesce("items_minor", F.lit(0))).alias("difference"))


def general_part(items: DataFrame, assignment: DataFrame) -> DataFrame:
    """(expense_id, general_minor): the sum of lines that nobody holds."""
    own = assignment.select("expense_id", F.col("position").alias("owner")).distinct()
    free = effective_owner(assignable(items)).join(own, ["expense_id", "owner"], "left_anti")
    return free.groupBy("expense_id").agg(F.sum("total_minor").alias("general_minor"))
