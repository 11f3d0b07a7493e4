"""Rate archive: cleaning, as-of lookups, crosses, history, conversion.

``archive``: (id, base, quote, rate, rate_date, fetched_at, source). Lookups merge the days
asked for with the days that have a rate, pair by pair, so their work is linear in both.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import RATE_SCALE, rate_num, with_converted

PIVOT = "EUR"
NOT_LOOKED_UP = ("cross", "manual")
HISTORY = 400


def clean(raw: DataFrame, currency: DataFrame) -> DataFrame:
    """Usable rates of ``raw(date, base, quote, rate)``: known currencies, base <> quote, a
    real date, a rate above 0; codes in upper case. Further columns stay with their rate."""
    more = [c for c in raw.columns if c not in ("date", "base", "quote", "rate", "rate_date")]
    codes = F.broadcast(currency.select("code"))
    df = raw.select(F.upper(F.trim("base")).alias("base"), F.upper(F.trim("quote")).alias("quote"), F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd").alias("rate_date"), F.col("rate").try_cast("decimal(38,18)").alias("rate"), *more)
    df = df.where("base <> quote AND rate_date IS NOT NULL AND rate > 0")
    return df.join(codes.withColumnRenamed("code", "base"), "base", "left_semi").join(codes.withColumnRenamed("code", "quote"), "quote", "left_semi")


def both_directions(archive: DataFrame) -> DataFrame:
    """(base, quote, num, den, ...) for provider rates and their inverses."""
    own = archive.where(~F.col("source").isin(*NOT_LOOKED_UP)).withColumn("num", rate_num(F.col("rate"))).where("num IS NOT NULL")
    scale = F.lit(RATE_SCALE).cast("decimal(20,0)")
    rest = ["id", "rate_date", "fetched_at", "source"]
    there = own.select("base", "quote", "num", scale.alias("den"), *rest)
    return there.unionByName(own.select(F.col("quote").alias("base"), F.col("base").alias("quote"), scale.alias("num"), F.col("num").alias("den"), *rest))


def newest_per_day(archive: DataFrame, *, by_source: bool = True) -> DataFrame:
    """The newest fetch per pair and day (and source); equal fetches: the largest id."""
    key = ["base", "quote", "rate_date", *(["source"] if by_source else [])]
    return archive.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("fetched_at"), F.desc("id")))).where("__n = 1").drop("__n")


FOUND = ("num", "den", "id", "rate_date", "fetched_at")


def _as_of(wanted: DataFrame, legs: DataFrame, day: str) -> DataFrame:
    """(from_cur, to_cur, day, on, first) of each wanted pair and day: the rate on or before
    the day, and the pair's earliest one. Days asked for and days with a rate are merged by a
    window over the pair; each day is there once, however many rows ask for it."""
    asked = wanted.select("from_cur", "to_cur", F.col(day).cast("date").alias(day)).distinct()
    rate = newest_per_day(legs, by_source=False).select(F.col("base").alias("from_cur"), F.col("quote").alias("to_cur"), F.col("rate_date").alias(day), F.struct(*FOUND).alias("__rate"))
    pair = Window.partitionBy("from_cur", "to_cur").orderBy(day)
    past = pair.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ever = pair.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = asked.withColumn("__asked", F.lit(True)).unionByName(rate, allowMissingColumns=True)
    known = merged.withColumn("__on", F.last("__rate", ignorenulls=True).over(past)).withColumn("__first", F.first("__rate", ignorenulls=True).over(ever))
    return known.where(F.col("__asked") & F.col(day).isNotNull()).select("from_cur", "to_cur", day, "__on", "__first")


def rate_on(wanted: DataFrame, legs: DataFrame, day: str = "day") -> DataFrame:
    """``wanted(from_cur, to_cur, day, ...)`` left-joined with the rate on or before the day;
    a NULL day or an unknown pair finds none."""
    df = wanted.join(_as_of(wanted, legs, day), ["from_cur", "to_cur", day], "left")
    return df.select(*wanted.columns, *[F.col(f"__on.{c}").alias(c) for c in FOUND])


def rate_near(wanted: DataFrame, legs: DataFrame, day: str = "day") -> DataFrame:
    """As :func:`rate_on`; where there is none, the earliest later rate, with ``later``."""
    df = wanted.join(_as_of(wanted, legs, day), ["from_cur", "to_cur", day], "left")
    later = F.col("__on").isNull() & F.col("__first").isNotNull()
    return df.select(*wanted.columns, *[F.coalesce(f"__on.{c}", f"__first.{c}").alias(c) for c in FOUND], later.alias("later"))


def latest(legs: DataFrame) -> DataFrame:
    """The latest rate of each pair."""
    best = F.max_by(F.struct("num", "den", "id", "rate_date", "fetched_at"), F.struct("rate_date", "fetched_at", "id"))
    return legs.groupBy("base", "quote").agg(best.alias("best")).select("base", "quote", "best.*")


def resolve(wanted: DataFrame, legs: DataFrame, day: str = "day", near: bool = False) -> DataFrame:
    """Add num, den, legs, quote_date, fetched_at for each of ``wanted(from_cur, to_cur, day)``.

    The same currency is 1 without a leg; a direct rate, either way, wins even over a
    fresher cross; else each leg over EUR is looked up by itself, and the quote has the
    date and fetch of the older one.
    """
    find = rate_near if near else rate_on
    slim = wanted.select("from_cur", "to_cur", day).distinct()
    take = lambda df, p: df.select(*[F.col(k) for k in ("from_cur", "to_cur", day)], *[F.col(c).alias(f"{p}{c}") for c in ("num", "den", "id", "rate_date", "fetched_at")])
    direct = take(find(slim, legs, day), "d_")
    first = find(slim.select("from_cur", F.lit(PIVOT).alias("to_cur"), day).distinct(), legs, day)
    second = find(slim.select(F.lit(PIVOT).alias("from_cur"), "to_cur", day).distinct(), legs, day)
    first = take(first, "a_").drop("to_cur")
    second = take(second, "b_").drop("from_cur")
    df = direct.join(first, ["from_cur", day], "left").join(second, ["to_cur", day], "left")
    same, has, cross = F.col("from_cur") == F.col("to_cur"), F.col("d_num").isNotNull(), F.col("a_num").isNotNull() & F.col("b_num").isNotNull()
    one = F.lit(1).cast("decimal(38,0)")
    pick = lambda d, c: F.when(has, d).when(cross, c)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    df = df.select(
        "from_cur", "to_cur", day,
        F.when(same, one).otherwise(pick(F.col("d_num").cast("decimal(38,0)"), (wide("a_num") * wide("b_num")).cast("decimal(38,0)"))).alias("num"),
        F.when(same, one).otherwise(pick(F.col("d_den").cast("decimal(38,0)"), (wide("a_den") * wide("b_den")).cast("decimal(38,0)"))).alias("den"),
        F.when(same, F.array().cast("array<string>")).otherwise(pick(F.array("d_id"), F.array("a_id", "b_id"))).alias("legs"),
        F.when(~same, pick(F.col("d_rate_date"), F.least("a_rate_date", "b_rate_date"))).alias("quote_date"),
        F.when(~same, pick(F.col("d_fetched_at"), F.least("a_fetched_at", "b_fetched_at"))).alias("fetched_at"),
    )
    # the two scales of a cross meet in num and den alike; what both share goes, so that a
    # product with an amount stays within 38 digits
    shared = F.lit(RATE_SCALE).cast("decimal(11,0)")
    both = (F.col("num") % shared == 0) & (F.col("den") % shared == 0)
    df = df.withColumn("__cut", both).withColumn("num", F.when(F.col("__cut"), (F.col("num") / shared).cast("decimal(38,0)")).otherwise(F.col("num"))).withColumn("den", F.when(F.col("__cut"), (F.col("den") / shared).cast("decimal(38,0)")).otherwise(F.col("den"))).drop("__cut")
    return wanted.join(df, ["from_cur", "to_cur", day], "left")


def chosen_rate(legs: Column) -> Column:
    """Which rate an expense keeps: none, the direct one, or a new cross of two."""
    return F.when(F.size(legs) == 0, "none").when(F.size(legs) == 1, F.concat(F.lit("direct:"), legs[0])).when(F.size(legs) == 2, F.concat(F.lit("cross:"), legs[0], F.lit("+"), legs[1]))


def convert_expenses(expense: DataFrame, legs: DataFrame, currency: DataFrame, base: str = PIVOT) -> tuple[DataFrame, DataFrame]:
    """(expenses with total_base_minor and base_currency, rejects without a rate): the rate
    on or before the expense's own day, else the earliest later one."""
    exp = F.broadcast(currency.select("code", "exponent"))
    wanted = expense.withColumn("from_cur", F.col("currency")).withColumn("to_cur", F.lit(base)).withColumn("day", F.col("occurred_date"))
    if base == PIVOT:
        # every rate is a direct one, so nothing is crossed: one lookup per currency and day
        slim = wanted.select("from_cur", "to_cur", "day").distinct()
        same = F.col("from_cur") == F.col("to_cur")
        near = rate_near(slim, legs).select(
            "from_cur", "to_cur", "day", F.when(same, F.lit(1)).otherwise(F.col("num")).cast("decimal(38,0)").alias("num"), F.when(same, F.lit(1)).otherwise(F.col("den")).cast("decimal(38,0)").alias("den"),
            F.when(same, F.array().cast("array<string>")).when(F.col("num").isNotNull(), F.array("id")).alias("legs"), F.when(~same, F.col("rate_date")).alias("quote_date"),
        )
        df = wanted.join(near, ["from_cur", "to_cur", "day"], "left")
    else:
        df = resolve(wanted, legs, near=True)
    df = df.join(exp.toDF("from_cur", "eb"), "from_cur", "left").join(exp.toDF("to_cur", "eq"), "to_cur", "left")
    other = F.when(F.col("from_cur") != F.col("to_cur"), F.col("total_minor"))
    df = with_converted(df, "__minor", other, F.col("num"), F.col("den"), F.col("eb"), F.col("eq"))
    minor = F.when(F.col("from_cur") == F.col("to_cur"), F.col("total_minor")).otherwise(F.col("__minor"))
    df = df.withColumn("total_base_minor", F.when(F.col("num").isNotNull(), minor)).withColumn("base_currency", F.lit(base))
    keep = [*expense.columns, "total_base_minor", "base_currency", "legs", "quote_date"]
    return df.where("num IS NOT NULL").select(*keep), df.where("num IS NULL").select("expense_id", F.lit("no_rate").alias("rule"), F.concat_ws(" ", "from_cur", "to_cur", "day").alias("detail"))


def history(archive: DataFrame, base: str, quote: str, cap: int = HISTORY) -> DataFrame:
    """:func:`histories` of one pair."""
    pair = archive.sparkSession.range(1).select(F.lit(base).alias("from_cur"), F.lit(quote).alias("to_cur"))
    return histories(archive, pair, cap).drop("from_cur", "to_cur")


def histories(archive: DataFrame, pairs: DataFrame, cap: int = HISTORY) -> DataFrame:
    """Rate histories of all ``pairs(from_cur, to_cur)`` at once, newest days first, at most
    ``cap`` lines each: from_cur, to_cur, line, rate_date, fetched_at, source, num, den, legs.
    A pair of one currency has no lines.

    A pair's own rates are its provider rates, the newest per day and source, and each manual
    and cross row. A pair without provider rates and without EUR has crosses besides, one per
    day a leg changed: the two change streams are merged by a window over the pair. Of a leg
    only its newest ``cap`` + 1 days can reach the list, so no more go into the merge.
    """
    pairs = pairs.where("from_cur <> to_cur").distinct()
    scale = F.lit(RATE_SCALE).cast("decimal(20,0)")
    wide = lambda c: c.cast("decimal(38,0)")
    rows = archive.withColumn("n", rate_num(F.col("rate"))).where("n IS NOT NULL")
    rest = ["rate_date", "fetched_at", "source", "id"]
    turned = rows.select(F.col("base").alias("from_cur"), F.col("quote").alias("to_cur"), *rest, wide(F.col("n")).alias("num"), wide(scale).alias("den")).unionByName(
        rows.select(F.col("quote").alias("from_cur"), F.col("base").alias("to_cur"), *rest, wide(scale).alias("num"), wide(F.col("n")).alias("den")))
    mine = turned.join(pairs, ["from_cur", "to_cur"], "left_semi")
    provided = ~F.col("source").isin(*NOT_LOOKED_UP)
    daily = Window.partitionBy("from_cur", "to_cur", "rate_date", "source").orderBy(F.desc("fetched_at"), F.desc("id"))
    newest = mine.where(provided).withColumn("__n", F.row_number().over(daily)).where("__n = 1").drop("__n")
    own = newest.unionByName(mine.where(~provided)).withColumn("legs", F.array("id")).drop("id")

    has = turned.where(provided).select("from_cur", "to_cur").distinct()
    crossed = pairs.where((F.col("from_cur") != PIVOT) & (F.col("to_cur") != PIVOT)).join(has, ["from_cur", "to_cur"], "left_anti")
    leg = newest_per_day(turned.where(provided).withColumnsRenamed({"from_cur": "base", "to_cur": "quote"}), by_source=False)
    leg = leg.where((F.col("base") == PIVOT) | (F.col("quote") == PIVOT)).withColumn("__n", F.row_number().over(Window.partitionBy("base", "quote").orderBy(F.desc("rate_date")))).where(F.col("__n") <= cap + 1)
    packed = F.struct("id", "rate_date", "fetched_at", "source", "num", "den")
    into = leg.where(F.col("quote") == PIVOT).select(F.col("base").alias("from_cur"), F.col("rate_date").alias("day"), packed.alias("a"))
    out = leg.where(F.col("base") == PIVOT).select(F.col("quote").alias("to_cur"), F.col("rate_date").alias("day"), packed.alias("b"))
    changes = crossed.join(into, "from_cur").unionByName(crossed.join(out, "to_cur"), allowMissingColumns=True)
    asof = Window.partitionBy("from_cur", "to_cur").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = changes.select("from_cur", "to_cur", F.last("a", ignorenulls=True).over(asof).alias("a"), F.last("b", ignorenulls=True).over(asof).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    met = met.withColumn("legs", F.array("a.id", "b.id")).dropDuplicates(["from_cur", "to_cur", "legs"])
    product = lambda c: wide(F.col(f"a.{c}").cast("decimal(19,0)") * F.col(f"b.{c}").cast("decimal(19,0)"))
    lines = met.select(
        "from_cur", "to_cur", F.greatest("a.rate_date", "b.rate_date").alias("rate_date"), F.least("a.fetched_at", "b.fetched_at").alias("fetched_at"),
        F.when(F.col("a.source") == F.col("b.source"), F.col("a.source")).otherwise(F.concat("a.source", F.lit(" + "), "b.source")).alias("source"), product("num").alias("num"), product("den").alias("den"), "legs")
    ranked = Window.partitionBy("from_cur", "to_cur").orderBy(F.desc("rate_date"), F.desc("fetched_at"), F.desc(F.concat_ws("+", "legs")))
    return own.unionByName(lines).withColumn("line", F.row_number().over(ranked)).where(F.col("line") <= cap)


def fill_from_fallback(primary: DataFrame, fallback: DataFrame, archive: DataFrame, primary_source: str, primary_failed: bool) -> DataFrame:
    """Primary rates, and fallback rates of currencies the primary lacks; if it failed, the
    currencies it was ever seen with still count as its own."""
    seen = archive.where(F.col("source") == primary_source).select("quote") if primary_failed else primary.select("quote")
    rest = fallback.join(seen.distinct(), "quote", "left_anti")
    return rest if primary_failed else primary.unionByName(rest)


def day_missing(rate_date: Column, day: Column, same: Column, tolerance: int = 4) -> Column:
    return ~same & (rate_date.isNull() | (rate_date < F.date_sub(day, tolerance)))


def is_stale(fetched_at_ms: Column, now_ms: Column, hours: int = 24) -> Column:
    return now_ms - fetched_at_ms > hours * 3_600_000


def archived_rate(wanted: DataFrame, archive: DataFrame) -> DataFrame:
    """``wanted(rate_id, from_cur, to_cur)`` with num and den of that archived rate, read in
    either direction; NULL for another pair."""
    r = archive.select(F.col("id").alias("rate_id"), "base", "quote", rate_num(F.col("rate")).alias("n"))
    df = wanted.join(r, "rate_id", "left")
    there = (F.col("base") == F.col("from_cur")) & (F.col("quote") == F.col("to_cur"))
    back = (F.col("base") == F.col("to_cur")) & (F.col("quote") == F.col("from_cur"))
    scale = F.lit(RATE_SCALE).cast("decimal(20,0)")
    return df.withColumn("num", F.when(there, F.col("n")).when(back, scale)).withColumn("den", F.when(there, scale).when(back, F.col("n"))).drop("base", "quote", "n")


def board(favourites: DataFrame, legs: DataFrame, home: str, manual: DataFrame | None = None) -> DataFrame:
    """(code, num, den, own): home to every other favourite at the latest rates; a manual
    rate overrides its own pair only. ``favourites`` is a user's short list."""
    df = F.broadcast(favourites.where(F.col("code") != home)).join(latest(legs).where(F.col("base") == home), F.col("code") == F.col("quote"), "left")
    if manual is None:
        return df.select("code", "num", "den", F.lit(False).alias("own"))
    own = manual.select(F.col("code"), F.col("num").alias("m_num"), F.col("den").alias("m_den"))
    df = df.join(own, "code", "left")
    return df.select("code", F.coalesce("m_num", "num").alias("num"), F.coalesce("m_den", "den").alias("den"), F.col("m_num").isNotNull().alias("own"))


def rerate(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``keeps_rate``: the archived rate stays if local day, currency, base and
    own rate are what they were."""
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("occurred_date", "currency", "base_currency", "own_rate")])
    return new.alias("n").join(old.alias("o"), "expense_id", "left").select("n.*", (F.col("o.currency").isNotNull() & same).alias("keeps_rate"))
