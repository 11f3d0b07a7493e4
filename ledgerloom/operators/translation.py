"""Translation memory: lookup, guarded upsert, missing texts, corrections, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(wanted: DataFrame, memory: DataFrame) -> DataFrame:
    """``wanted(source_lang, target_lang, source_text)`` with ``translated_text``: the newest
    user correction of the text from any language, else the machine entry of the very
    language, else NULL. Without a source language only corrections count."""
    own = memory.where("from_user").groupBy("target_lang", "source_text").agg(F.max_by("translated_text", F.struct("updated_at", "translated_text")).alias("own"))
    machine = memory.where("NOT from_user").groupBy("source_lang", "target_lang", "source_text").agg(F.max_by("translated_text", F.struct("updated_at", "translated_text")).alias("machine"))
    df = wanted.join(own, ["target_lang", "source_text"], "left").join(machine, ["source_lang", "target_lang", "source_text"], "left")
    return df.withColumn("translated_text", F.coalesce("own", "machine")).drop("own", "machine")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Memory after ``new``: per key the user's entry wins, then the newest."""
    row = F.struct("translated_text", "from_user", "updated_at")
    best = memory.unionByName(new).groupBy("source_lang", "target_lang", "source_text").agg(F.max_by(row, F.struct("from_user", "updated_at", "translated_text")).alias("best"))
    return best.select("source_lang", "target_lang", "source_text", "best.*")


def missing(texts: DataFrame, memory: DataFrame, target: str) -> DataFrame:
    """Distinct texts that aren't blank, are in another known language and have no entry."""
    known = memory.where(F.col("target_lang") == target).select("source_text").distinct()
    want = texts.where((F.trim("source_text") != "") & F.col("source_lang").isNotNull() & (F.col("source_lang") != target)).select("source_lang", "source_text").distinct()
    return want.join(known, "source_text", "left_anti")


def usable_results(results: DataFrame) -> DataFrame:
    """Translations that aren't empty and differ from their source."""
    return results.where((F.trim("translated_text") != "") & (F.col("translated_text") != F.col("source_text")))


def corrections(edited: DataFrame, target: str) -> DataFrame:
    """Entries to remember from edited lines: trimmed, not empty, changed; an unknown
    language is "und"."""
    text = F.trim("edited")
    keep = edited.where((text != "") & ~text.eqNullSafe(F.col("translated_text")))
    return keep.select(F.coalesce("source_lang", F.lit("und")).alias("source_lang"), F.lit(target).alias("target_lang"), "source_text", text.alias("translated_text"), F.lit(True).alias("from_user"), "updated_at")


def passes(level: str, mean: Column, low: Column) -> Column:
    """Confidence gates on mean and lowest log probability."""
    gates = {"strict": (-0.6, -1.0), "balanced": (-1.0, -2.0)}
    if level == "all":
        return F.lit(True)
    m, l = gates[level]
    return (mean >= m) & (low >= l)
