"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get dense numbers 0..n-1 in a fixed order; a keyed permutation of 0..n-1 shuffles
them; shard and slot of a row are the remainder and quotient of its place. So where a row
goes can be computed from its number, and counts of shards differ by one at most.

DataFrame functions only. Law: ``rows``.

Odd input: null text has size 1 and CRC 0; a null doc_id sorts first; equal rows get
different places (which of them gets which does not matter); an empty table gives no
rows; extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_start

ROUNDS = 6


def feistel_once(place: Column, a: int, b: int, key: int, rounds: int = ROUNDS) -> Column:
    """One pass of an alternating Feistel network over 0..a*b-1.

    A number is (left, right) = (place div b, place mod b); each round adds a keyed hash
    of one half to the other, modulo that half's size, so it can be undone.
    """
    expr = place
    left, right = F.floor(expr / F.lit(b)).cast("long"), expr % F.lit(b)
    state = F.struct(left.alias("l"), right.alias("r"))
    for i in range(rounds):
        state = _round(state, i, a, b, key)
    return state["l"] * F.lit(b) + state["r"]


def _round(state: Column, i: int, a: int, b: int, key: int) -> Column:
    def step(s: Column) -> Column:
        if i % 2 == 0:
            return F.struct(F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], F.lit(key), F.lit(i)), F.lit(a)), F.lit(a)).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], F.lit(key), F.lit(i)), F.lit(b)), F.lit(b)).alias("r"))

    # one element, so that Spark computes the state once a round and not once a use
    return F.transform(F.array(state), step)[0]


def permuted(number: Column, n: int, key: int) -> Column:
    """The place of ``number`` in a keyed shuffle of 0..n-1.

    The network works on a*b >= n numbers with a*b - n <= 2*sqrt(n): a place of n or more
    is put through it again. A walk leaves those after at most a*b - n steps; with many
    rows 64 steps do, since each fails with a chance under 2/sqrt(n). One that doesn't
    end raises an error.
    """
    b = max(1, math.isqrt(max(0, n - 1)) + 1)
    a = max(1, -(-n // b))
    spare = a * b - n
    place = feistel_once(number, a, b, key)
    if spare:
        steps = F.sequence(F.lit(1), F.lit(min(spare, 64)))
        walked = F.aggregate(steps, place, lambda p, _: F.when(p < n, p).otherwise(feistel_once(p, a, b, key)))
        place = F.when(place < n, place).otherwise(walked)
        place = F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return place


def global_numbers(docs: DataFrame, n: int, order: list[str], rows_each: int = 20_000) -> DataFrame:
    """Add ``row_number`` to the ``n`` rows of ``docs``: dense, from 0, the same in every run over the same rows.

    Rows are numbered by (hash bucket, ``order``), which needs sums per bucket and a sort
    inside each, never a global sort.
    """
    buckets = max(64, -(-n // rows_each))
    docs = docs.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    return running_start(docs, ["__all"], bucket, [F.col(c).asc_nulls_first() for c in order], "__one", "row_number").drop("__one", "__all")


def shard(docs: DataFrame, shards: int = 8, key: int = 20_240_601, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, place).

    ``size`` is the text's UTF-8 bytes plus 1. ``slot`` is gapless from 0 in each shard;
    ``grown_shard`` is null, since the law is ``rows``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    slim = materialize(slim, "to-shard")
    n = slim.count()
    numbered = global_numbers(slim, n, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, key))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )
