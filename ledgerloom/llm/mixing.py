"""Mixing sources to target weights by entropy balancing.

Among all document rates r with the wanted tokens per source, the one closest to the
prior rates q in relative entropy, sum r log(r/q) - r + q over documents, subject to
r <= cap, is an exponential tilt: r = min(cap, q * exp(lambda of the source * size)). So a
source that must shrink gives up its long documents first, and one that must grow repeats
them. The lambdas solve the convex dual; each Newton step is one aggregation over the
cells (source, size, q). The rates are then rounded into whole copies, and documents take
a part of one more so that the words taken meet the target to the word.

DataFrame functions only.

Odd input: null text has size 0 and takes 0; a null source is a source of its own, last in
order; a null doc_id is a document like others; equal rows are separate documents; an
empty table gives no rows; a total of 0 gives targets of 0; extra columns are ignored by
:func:`mix_sizes` and kept by :func:`mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, materialize, running_start

CAP = 3.0
TOLERANCE = 1e-11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``: shares of the whole
    size by weight, stopped at ``cap`` times the own size, the excess shared again by
    weight until none is above.

    The end of that is target = min(cap * size, level * weight) for one level. Sources
    stop in the order of cap * size / weight, so the level follows from running sums.
    """
    limit = F.lit(cap) * F.col("source_size")
    all_rows = Window.partitionBy(F.lit(0))
    order = all_rows.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if this source and all later ones stay below their stops; the first that fits holds
    steps = (
        sources.withColumn("ratio", limit / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"])
    )
    target = F.least(limit, F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return steps.withColumn("target", target.cast("double")).drop("ratio", "level")


def cyclic_weights(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): weights 1, 2, 3, 1, ... by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return per.withColumn("weight", ((place - 1) % 3 + 1).cast("long"))


def tilts(sizes: DataFrame, targets: DataFrame, cap: float = CAP, max_steps: int = 100) -> DataFrame:
    """(source, lam, steps): the dual solution for ``sizes(source, size, prior)``, and how
    many Newton steps it took.

    The words got are a sum over cells of equal size and prior rate; they and their
    derivative are decimals, so that their order doesn't matter. They grow with lambda, so
    each source keeps an interval that holds its root, and a step that would leave it halves
    it instead. A source whose target is its cap gets null: all its documents reach it. The
    driver sees one number a step.
    """
    cells = materialize(sizes.where("size > 0 and prior > 0").groupBy("source", "size", "prior").agg(F.count("*").alias("n")), "cells")
    base = F.sum(F.col("n") * F.col("size") * F.least(F.lit(cap), "prior"))
    top = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("whole"), F.min("prior").alias("least"), F.min("size").alias("short"), base.alias("base"))
    low = F.when(F.col("target") < F.col("base"), F.log(F.col("target") / F.col("base")) / F.col("short")).otherwise(0.0)
    high = F.when(F.col("target") < F.col("base"), 0.0).otherwise(F.log(F.lit(cap) / F.col("least")) / F.col("short"))
    state = targets.alias("t").join(top.alias("p"), F.expr("t.source <=> p.source")).select("t.source", "target", low.alias("low"), high.alias("high"), ((F.col("target") <= 0) | (F.col("target") >= F.lit(cap) * F.col("whole") * (1 - 1e-12))).alias("done"))
    state = state.withColumn("lam", F.lit(0.0)).withColumn("steps", F.lit(0))
    state = materialize(state, "tilts")
    for _ in range(max_steps):
        rate = F.col("prior") * F.exp(F.col("lam") * F.col("size"))
        exact = lambda x: F.sum(x.cast("decimal(38,12)"))
        sums = (
            cells.alias("c").join(state.alias("s"), F.expr("c.source <=> s.source")).where("not done").groupBy(F.col("s.source").alias("of"))
            .agg(exact(F.col("n") * F.col("size") * F.least(F.lit(cap), rate)).cast("double").alias("got"), exact(F.when(rate < cap, F.col("n") * F.col("size") * F.col("size") * rate).otherwise(0.0)).cast("double").alias("slope"))
        )
        joined = state.join(sums, F.expr("source <=> of"), "left")
        over = F.col("got") > F.col("target")
        joined = joined.withColumn("low", F.when(over, F.col("low")).otherwise(F.greatest("low", "lam"))).withColumn("high", F.when(over, F.least("high", "lam")).otherwise(F.col("high")))
        step = F.col("lam") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        settled = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-16 * F.abs(F.col("lam")))
        after = joined.select(
            "source", "target", "low", "high", settled.alias("done"),
            F.when(settled, F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("low") + F.col("high")) / 2).alias("lam"), F.when(settled, F.col("steps")).otherwise(F.col("steps") + 1).alias("steps"),
        )
        new = materialize(after, "tilts")
        discard(state)
        state = new
        if not state.select(F.max((~F.col("done")).cast("int"))).first()[0]:
            # a null lambda: all at the cap, or nothing wanted
            plan = targets.alias("t").join(top.alias("p"), F.expr("t.source <=> p.source")).select(F.col("t.source").alias("of"), (F.col("target") >= F.lit(cap) * F.col("whole") * (1 - 1e-12)).alias("full"))
            return state.join(plan, F.expr("source <=> of")).select("source", F.when(~F.col("full") & (F.col("target") > 0), F.col("lam")).alias("lam"), "full", "steps")
    raise RuntimeError(f"the dual did not settle in {max_steps} steps")


def uniform(name: Column) -> Column:
    """A number in [0, 1) that depends on ``name`` alone: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sizes(sizes: DataFrame, targets: DataFrame | None = None, cap: float = CAP, rows_each: int = 20_000) -> DataFrame:
    """``sizes(doc_id, source, size, draw, ...)`` with source_size, target, rate and taken.

    Every document takes floor(rate) whole copies. The words still missing are taken in
    the order of draw / frac(rate) (sequential Poisson sampling), each document once, until
    the target is met; the last one is cut. ``draw`` is uniform in [0, 1); ``prior`` is 1
    where there is none.
    """
    if "prior" not in sizes.columns:
        sizes = sizes.withColumn("prior", F.lit(1.0))
    sizes = materialize(sizes, "sizes")
    plan = materialize(water_fill(cyclic_weights(sizes), cap) if targets is None else targets, "targets")
    solved = materialize(plan.alias("p").join(tilts(sizes, plan, cap).alias("l"), F.expr("p.source <=> l.source"), "left").select("p.source", "p.source_size", "p.target", "l.lam", "l.full"), "solved")
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("prior") * F.exp(F.col("lam") * F.col("size"))))
    rated = sizes.alias("d").join(solved.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
    rated = rated.withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = rated.withColumn("turn", F.when(F.col("part") > 1e-9, F.col("draw") / F.col("part")))
    # documents without a part come after all others, in any order
    rated = rated.withColumn("place", F.coalesce("turn", 1e18 + F.pmod(F.xxhash64("doc_id", "size", "draw"), F.lit(1 << 40)) * 1e6))
    parts = max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // rows_each))
    # ranges of the order, of about equal rows; the result doesn't depend on where they are cut
    rated = materialize(rated.repartitionByRange(parts, F.col("source").asc_nulls_first(), "place").withColumn("range", F.spark_partition_id()), "rated")
    missing = rated.groupBy("source").agg((F.round(F.first("target")) - F.sum(F.col("whole") * F.col("size"))).cast("long").alias("missing"))
    order = [F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    able = F.when(F.col("turn").isNull(), 0).otherwise(F.col("size"))
    placed = running_start(rated.withColumn("able", able), ["source"], F.col("range"), order, "able", "before")
    joined = placed.alias("d").join(materialize(missing, "missing").alias("m"), F.expr("d.source <=> m.source")).select("d.*", "missing")
    extra = F.greatest(F.lit(0), F.least(F.col("able"), F.col("missing") - F.col("before")))
    return joined.withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("long")).drop("able", "before", "missing", "turn", "place", "part", "range", "draw")


def _sizes(docs: DataFrame, *keys: Column) -> DataFrame:
    draw = uniform(F.coalesce(F.col("doc_id").cast("long").cast("string"), "text", F.lit("")))
    return docs.select(*keys, F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), draw.alias("draw"))


def mix(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, rate): one row per document."""
    return mix_sizes(_sizes(docs), cap=cap).select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken", "rate")


def mix_documents(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as often as it is taken, a part of a copy cut after
    its last word. Columns as in ``docs``; ``n_chars`` follows the text where it exists."""
    # the row travels as one struct
    rows = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "to-mix")
    taken = mix_sizes(_sizes(rows.select("doc.doc_id", "doc.source", "doc.text", "row"), F.col("row")), cap=cap).where("taken > 0").select("row", "size", "taken")
    copies = rows.join(taken, "row").withColumn("copy", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    left = F.col("taken") - F.col("copy") * F.col("size")
    pieces = F.regexp_extract_all(F.col("doc.text"), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    text = F.when(left >= F.col("size"), F.col("doc.text")).otherwise(F.array_join(F.slice(pieces, 1, left.cast("int")), ""))
    changed = {"text": text, "n_chars": F.length(text)}
    return copies.select(*[changed.get(c, F.col("doc")[c]).cast(t).alias(c) for c, t in docs.dtypes])


#: The tilt of each source by halving, 200 times, where the operator takes Newton steps.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s
), l AS (
  SELECT arg_min((total - stopped) / open_weight, ratio) FILTER (WHERE (total - stopped) / open_weight <= ratio) AS level FROM r
), t AS (
  SELECT source, source_size, CAST(least(3.0::DOUBLE * source_size, coalesce(level, 0) * weight) AS DOUBLE) AS target FROM r, l
), c AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL
), b AS (
  SELECT 0 AS step, t.source, target, target >= 3.0::DOUBLE * source_size * (1 - 1e-12) AS full_,
         CASE WHEN target > 0 AND target < source_size THEN ln(target / source_size) / min(size) ELSE 0 END AS low, CASE WHEN target < source_size THEN 0 ELSE ln(3.0::DOUBLE) / min(size) END AS high
  FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source GROUP BY t.source, t.target, t.source_size
  UNION ALL
  SELECT step + 1, b.source, target, full_, CASE WHEN got <= target THEN mid ELSE low END, CASE WHEN got <= target THEN high ELSE mid END
  FROM b JOIN (
    SELECT b.source AS of, any_value((low + high) / 2) AS mid, sum(n * size * least(3.0::DOUBLE, exp((low + high) / 2 * size))) AS got
    FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source GROUP BY b.source
  ) g ON b.source IS NOT DISTINCT FROM g.of
  WHERE step < 200
), x AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
         CASE WHEN d.size = 0 OR t.target <= 0 THEN 0 WHEN full_ THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, exp((low + high) / 2 * d.size)) END AS rate,
         CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON b.step = 200 AND b.source IS NOT DISTINCT FROM t.source
), w AS (
  SELECT *, CAST(floor(rate + 1e-9) AS BIGINT) AS whole, rate - floor(rate + 1e-9) > 1e-9 AS parted, CASE WHEN rate - floor(rate + 1e-9) > 1e-9 THEN draw / (rate - floor(rate + 1e-9)) END AS turn FROM x
), o AS (
  SELECT *, CAST(round(target) AS BIGINT) - sum(whole * size) OVER (PARTITION BY source) AS missing,
         CASE WHEN parted THEN coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS earlier
  FROM w
)
SELECT doc_id, size, source_size, target, CAST(whole * size + CASE WHEN parted THEN greatest(0, least(size, missing - earlier)) ELSE 0 END AS BIGINT) AS taken
FROM o
"""
