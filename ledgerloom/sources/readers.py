"""Readers of rate feeds, recognised receipts and ground truth. Schemas are declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE_ROWS = "date string, base string, quote string, rate decimal(38,18)"
OCR = "skew_degrees float, fragments array<struct<text: string, box: array<int>, confidence: float>>, image_size array<int>"
FRAGMENT = "left int, top int, right int, bottom int, text string"


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't deleted."""
    return df.where("deleted_at IS NULL")


def rate_rows(spark: SparkSession, path: str) -> DataFrame:
    """Feed of [{date, base, quote, rate}]; rates are read as decimals at once."""
    return spark.read.schema(RATE_ROWS).json(path, multiLine=True)


def rate_map(lines: DataFrame, base: str = "EUR", value: str = "value") -> DataFrame:
    """Feed of {date, <base in lower case>: {code: rate}} in the column ``value``."""
    schema = f"date string, {base.lower()} map<string, decimal(38,18)>"
    doc = lines.select(F.from_json(value, schema).alias("d")).select("d.date", F.explode(f"d.{base.lower()}").alias("quote", "rate"))
    return doc.select("date", F.lit(base).alias("base"), F.upper("quote").alias("quote"), "rate")


def fragments_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Recognised fragments, one file per receipt, ``#`` lines are comments."""
    df = spark.read.schema(FRAGMENT).csv(path, sep="\t", comment="#", quote="")
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1).alias("receipt_id"), *[f.split()[0] for f in FRAGMENT.split(", ")])


def fragments_json(receipts: DataFrame, column: str = "ocr_boxes") -> DataFrame:
    """One row per fragment of the JSON documents in ``column``."""
    doc = receipts.select("receipt_id", F.from_json(column, OCR).alias("d")).select("receipt_id", F.posexplode("d.fragments").alias("idx", "f"))
    box = lambda i: F.get("f.box", F.lit(i))
    return doc.select("receipt_id", "idx", box(0).alias("left"), box(1).alias("top"), box(2).alias("right"), box(3).alias("bottom"), "f.text", "f.confidence")


def truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(receipt_id, currency, total, date, time, store, items) from key/value lines."""
    return truth_text(spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.tsv$", 1).alias("receipt_id"), "value", F.monotonically_increasing_id().alias("at")))


def truth_text(lines: DataFrame) -> DataFrame:
    """The same from (receipt_id, at, value): lines in the order of ``at``."""
    kv = lines.select("receipt_id", "at", F.split("value", "\t", 2).alias("kv")).select("receipt_id", "at", F.get("kv", F.lit(0)).alias("k"), F.get("kv", F.lit(1)).alias("v"))
    one = lambda key: F.max(F.when(F.col("k") == key, F.col("v"))).alias(key)
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == "item", F.struct("at", "v")))), lambda x: x["v"]).alias("items")
    return kv.groupBy("receipt_id").agg(*[one(k) for k in ("currency", "total", "tax", "date", "time", "store")], items)


def dataset_records(records: DataFrame) -> DataFrame:
    """(id, word boxes, amount, date) of annotated records with JSON columns words, fields."""
    words = "array<struct<text: string, x0: double, y0: double, x1: double, y1: double>>"
    fields = "merchant string, date string, time string, currency string, total string"
    d = records.select("id", F.from_json("words", words).alias("w"), F.from_json("fields", fields).alias("f"))
    return d.select("id", F.size("w").alias("words"), amount_only(F.col("f.total")).alias("total"), "f.currency", F.to_date(F.try_to_timestamp("f.date")).alias("date"))


def amount_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.,-]", "")
