"""Streams with the semantics of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fx import both_directions, clean, convert_expenses


def stream_rates(feed: DataFrame, currency: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of ``feed(date, base, quote, rate, fetched_at, source)`` to
    the archive. A batch that is run again replaces its own files, and a row (source, fetch,
    pair, day) that an earlier batch has is not written again, so nothing doubles, also after
    a restart from the checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        good = clean(batch.select("date", "base", "quote", "rate", "fetched_at", "source"), currency)
        rows = good.withColumn("id", F.concat_ws("-", "source", F.col("fetched_at").cast("string"), "base", "quote", F.col("rate_date").cast("string")))
        rows = rows.dropDuplicates(["id"])
        if batch_id:  # batch 0 has always been written before, if only as an empty table
            rows = rows.join(batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id).select("id"), "id", "left_anti").select(*rows.columns)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_convert(expenses: DataFrame, read_archive, currency: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Convert arriving expenses at their day's rate; the archive is read anew each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done, rejects = convert_expenses(batch, both_directions(read_archive()), currency)
        done.drop("legs").write.mode("overwrite").parquet(f"{path}/converted/batch={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")

    return expenses.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_cash_balances(movements: DataFrame) -> DataFrame:
    """Running balance per person and currency, for update mode; one state row per key."""
    return movements.groupBy("person_id", "currency").agg(F.sum("amount_minor").alias("balance"))


def stream_balances_to(movements: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running balances of ``movements(person_id, currency, amount_minor)`` in update mode: each
    batch writes the balances it changed; :func:`latest_balances` reads the last of each key.
    The sums live in the state store, so a restart goes on where the stream stopped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream_cash_balances(movements).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_balances(written: DataFrame) -> DataFrame:
    """(person_id, currency, balance) of all batches that :func:`stream_balances_to` wrote."""
    return written.groupBy("person_id", "currency").agg(F.max_by("balance", "batch").alias("balance"))


def refresh_due(last_fetch_ms: Column, now_ms: Column, eager: Column) -> Column:
    """Whether rates should be fetched: none yet, or older than a day (an hour at the start)."""
    age = F.when(eager, 3_600_000).otherwise(24 * 3_600_000)
    return last_fetch_ms.isNull() | (now_ms - last_fetch_ms >= age)
