"""Line numbers of long lists without one task that holds a whole list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import shared_path


def lines_by_bucket(df: DataFrame, group: list[str], bucket: Column, order: list[Column], line: str = "line") -> DataFrame:
    """Add ``line``, from 1 within ``group``. Rows of a lower ``bucket`` come first, rows of one
    bucket in ``order``: rows are counted per bucket, the counts are added up, and only the
    rows of one bucket are sorted in one task."""
    df = df.withColumn("__b", bucket)
    keys = [*group, "__b"]
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys).agg(F.count("*").alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    numbered = df.withColumn(line, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(per, keys).withColumn(line, F.col("__before") + F.col(line)).drop("__b", "__before")


def lines_of_all(df: DataFrame, order: list[Column], line: str = "line", ranges: int | None = None) -> DataFrame:
    """Add ``line``, the place from 1 among all rows in ``order``, which must tell rows apart.

    Ranges of the order are sorted side by side and written to the shared folder once, so
    that their numbers and their sizes are those of one and the same sort.
    """
    spark = df.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_path(spark, "lines")
    place = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    sorted_rows.withColumn("__range", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    written = spark.read.parquet(path)
    # one row a range
    sizes = written.groupBy("__range").agg(F.count("*").alias("__k"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    return written.join(starts, "__range").withColumn(line, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")
