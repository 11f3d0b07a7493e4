"""Shared helpers: materialised tables, prefix sums, components, byte-level hashing.

Nothing here keeps state between calls; every helper takes and returns DataFrames or
numpy arrays.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separator of words: a run of anything but these is a word.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Set while a table is written: shuffle files go when the write ends, and batches for
#: Python stay small, since a row may hold a whole shard of texts.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


# ------------------------------------------------------------------ written tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine takes a folder of its own; any other must
    name one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = Path(tempfile.mkdtemp(prefix="shared-")).as_uri()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs one re-read, not the stages before it. The
    shuffle files of the write are given back as soon as it has ended. With ``buckets``, a
    number and a column, joins on that column don't shuffle the table again; it is then
    known to the session's catalog until :func:`discard`.
    """
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    path = os.path.join(shared_dir(spark), table)
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.options(**(options or {}))
        if buckets:
            table = table.replace("-", "_")
            writer.format("parquet").option("path", path).bucketBy(*buckets).sortBy(buckets[1]).saveAsTable(table)
        else:
            writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.table(table) if buckets else spark.read.schema(df.schema).parquet(path)
    out.written_to, out.known_as = path, table if buckets else None
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that nothing is read from any more."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path is not None:
            if t.known_as:
                t.sparkSession.sql(f"DROP TABLE IF EXISTS {t.known_as}")
            jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def partitions_for(df: DataFrame, rows_each: int, rows: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


# ------------------------------------------------------------------ prefix sums
def running_start(df: DataFrame, group: list[str], bucket: Column, order: list[Column], size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over all earlier rows of the same ``group``.

    Earlier means a smaller ``bucket``, or the same bucket and earlier in ``order``. Two
    levels: sums per (group, bucket), a window over those few rows, then a window inside
    each bucket; so no task ever holds a whole group.
    """
    b, base = "__bucket", "__base"
    df = df.withColumn(b, bucket)
    per = df.groupBy(*group, b).agg(F.sum(size).alias("__sum"))
    w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(base, F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")
    keys = [*group, b]
    joined = df.alias("l").join(per.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]).select("l.*", base)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col(base) + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop(b, base)


def range_start(df: DataFrame, order: list[Column], size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over all rows that come earlier in ``order``, which must
    tell rows apart. Ranges of the order, which Spark draws evenly, are written once with their
    numbers; their sums are few rows, and a range is one task's work."""
    rows = df.count()
    ranged = df.repartitionByRange(partitions_for(df, 200_000, rows), *order).withColumn("__range", F.spark_partition_id())
    written = materialize(ranged, "ranges")
    per = written.groupBy("__range").agg(F.sum(size).alias("__sum"))
    per = per.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return written.join(per, "__range").withColumn(out, F.col("__base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("__range", "__base")


# ------------------------------------------------------------------ connected components
def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` can reach.

    Hooking and pointer jumping: a node and its root take the smallest root among the
    node's neighbours, then every root is replaced by its own root, so paths halve each
    round. Every join is between two written tables, so Spark can split a node with many
    links; the driver sees one number a round. Self-loops and repeats are allowed; nulls
    are not.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    links = materialize(both.where("u <> v").distinct(), "links")
    roots = materialize(links.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")), "roots")
    seen = None
    for _ in range(max_rounds):
        near = links.join(roots, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        offers = roots.join(near, F.col("node") == F.col("u")).select(
            F.explode(F.array(F.struct("node", F.least("root", "near").alias("root")), F.struct(F.col("root").alias("node"), F.least("root", "near").alias("root")))).alias("o")
        )
        hooked = materialize(offers.groupBy("o.node").agg(F.min("o.root").alias("root")), "roots")
        discard(roots)
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = materialize(hooked.join(above, "root").select("node", F.least("root", "top").alias("root")), "roots")
        discard(hooked)
        state = roots.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            discard(links)
            return roots
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# ------------------------------------------------------------------ bytes in numpy
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of the ordered pair (a, b), element by element."""
    x = a * M1
    x ^= x >> np.uint64(29)
    x += b
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def gram_hashes(buf: np.ndarray, sizes: tuple[int, ...], block: int = 1 << 17) -> dict[int, np.ndarray]:
    """Hashes of every run of k bytes of ``buf`` (uint8), for each k of ``sizes``, each at
    most 64, built by doubling in blocks that stay in the cache. Result k has len(buf)-k+1
    entries."""
    n, top = len(buf), max(sizes)
    out = {k: np.empty(max(0, n - k + 1), np.uint64) for k in sizes}
    for at in range(0, n, block):
        part = buf[at : at + block + top].astype(np.uint64)
        power = {1: (part + np.uint64(1)) * M3}
        w = 1
        while w * 2 <= top and len(part) > w:
            h = power[w]
            power[w * 2] = mix(h[:-w] if w < len(h) else h[:0], h[w:])
            w *= 2
        for k in sizes:
            room = min(block, max(0, n - k + 1 - at))
            if room <= 0:
                continue
            have, pos = None, 0
            for bit in (64, 32, 16, 8, 4, 2, 1):
                if k & bit:
                    piece = power[bit][pos : pos + room]
                    have = piece if have is None else mix(have, piece)
                    pos += bit
            out[k][at : at + room] = finish(have)
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``. Put a space between texts beforehand."""
    space = np.zeros(256, bool)
    space[list(SPACE_BYTES)] = True
    inside = ~space[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each [start, end)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(buf)
    value = finish(buf.astype(np.uint64) + M2)
    value *= _powers(n, _BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    part = (total[ends] - total[starts]) * _powers(n, _INVERSE)[starts]
    return finish(part + (ends - starts).astype(np.uint64) * M3)


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """One uint8 buffer of all texts, each followed by one space, and where each begins
    (one entry more than texts)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b" ".join(raw) + b" " if raw else b"", np.uint8), at
