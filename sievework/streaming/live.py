"""Live figures over the event log as a stream (an addition: the batch operators fold the same log once)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Events and their values by kind and hour; events later than ``late`` are left out."""
    d = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return d.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def fold_batches(
    events: DataFrame, fold: Callable[[DataFrame], DataFrame], log_path: str, out_path: str, checkpoint: str, combine: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append each micro-batch to the log and write the fold of the whole log; a batch that is run again changes nothing.

    A batch's rows lie in a folder named after it, so writing it again replaces it. With ``combine`` each batch is folded by itself, its fold is kept beside the log, and only the
    folds are combined, so a batch costs its own rows and a small row for each earlier one; without it the whole log is folded each time.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        spark = batch.sparkSession
        if combine is None:
            fold(spark.read.parquet(log_path).drop("batch")).write.mode("overwrite").parquet(out_path)
            return
        fold(batch).write.mode("overwrite").parquet(f"{log_path}-folds/batch={number}")
        combine(spark.read.parquet(f"{log_path}-folds").drop("batch")).write.mode("overwrite").parquet(out_path)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
