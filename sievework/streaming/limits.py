"""Limits of runs while their results arrive: failures in a row, cost so far, requests in a window, kept as one row of state for each run.

A micro-batch is folded as the batch operators fold a log, in stretches, so a run that has a third of all results is many tasks; only its row of state is carried on. The state
of a batch lies in a folder named after it and is made from that of the batch before, so a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.running import running
from sievework.operators.screening import busiest_windows
from sievework.storage import cut, drop_paths

FAILED = ("parse_error", "api_error", "truncated")
STATE = (
    "run_id string, calls long, cost double, trailing long, longest long, tripped_line long, stop_line long, max_requests long, max_tokens long, last_s long, recent array<struct<ts:long,r:long,t:long>>"
)


def next_state(state: DataFrame, batch: DataFrame, threshold: int, cost_limit: float, concurrency: int = 1, seconds: int = 60) -> DataFrame:
    """The state after a batch of (run_id, line_no, status, cost, ts in seconds, tokens), whose lines come after all earlier ones of their run.

    calls, cost; ``trailing`` failures in a row at the end, ``longest`` of all, ``tripped_line`` at which ``threshold`` were reached; ``stop_line`` at which the cost so far and
    the average of the calls in flight reach ``cost_limit``; the most requests and tokens in any window of ``seconds``, for which the last seconds are kept as ``recent``. Runs without rows
    in the batch stay as they were. Nulls: rows without a run or line are left out, a null cost or number of tokens is 0, and a null time counts in no window.
    """
    rows = cut(batch.where("run_id IS NOT NULL AND line_no IS NOT NULL").select("run_id", "line_no", F.coalesce(F.col("status").isin(*FAILED), F.lit(False)).alias("bad"), F.coalesce("cost", F.lit(0.0)).alias("cost"), "ts", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "batch")
    before = state.select("run_id", *(F.col(c).alias(f"b_{c}") for c in ("calls", "cost", "trailing")))
    d = running(rows, "line_no", {"k": 1, "c": "cost", "good": F.when(F.col("bad"), 0).otherwise(1), "failed": F.col("bad").cast("int")}).join(before, "run_id", "left")
    d = cut(d.na.fill(0, ["b_calls", "b_cost", "b_trailing"]), "folded")
    # failures since a success; those before the batch's first success go on from the ones at the end of the batch before
    islands = d.where("bad").groupBy("run_id", "good").agg(F.min("failed").alias("first"), F.count("*").alias("n"), F.max("b_trailing").alias("b"))
    islands = islands.withColumn("n", F.col("n") + F.when(F.col("good") == 0, F.col("b")).otherwise(0))
    tripped = d.where("bad").join(islands.select("run_id", "good", "first"), ["run_id", "good"])
    tripped = tripped.where(F.col("failed") - F.col("first") + 1 + F.when(F.col("good") == 0, F.col("b_trailing")).otherwise(0) >= threshold).groupBy("run_id").agg(F.min("line_no").alias("tripped"))
    spent, calls = F.col("b_cost") + F.col("c"), F.col("b_calls") + F.col("k")
    sums = d.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.max("good").alias("good"), F.min(F.when(spent + spent / calls * concurrency >= cost_limit, F.col("line_no"))).alias("stop"))
    ends = islands.select("run_id", F.col("good"), F.col("n").alias("tail"))
    sums = sums.join(ends, ["run_id", "good"], "left").join(islands.groupBy("run_id").agg(F.max("n").alias("most")), "run_id", "left").join(tripped, "run_id", "left")

    old = state.select("run_id", F.explode("recent").alias("x")).select("run_id", "x.*")
    seconds_ = rows.where("ts IS NOT NULL").groupBy("run_id", F.col("ts").cast("long").alias("ts")).agg(F.count("*").alias("r"), F.sum("tokens").alias("t")).union(old)
    seconds_ = cut(seconds_.groupBy("run_id", "ts").agg(F.sum("r").alias("r"), F.sum("t").alias("t")), "seconds")
    last = seconds_.groupBy("run_id").agg(F.max("ts").alias("last_s"))
    kept = seconds_.join(last, "run_id").where(F.col("ts") > F.col("last_s") - seconds).groupBy("run_id", "last_s").agg(F.array_sort(F.collect_list(F.struct("ts", "r", "t"))).alias("new"))
    wins = busiest_windows(seconds_, seconds).withColumnsRenamed({"max_requests": "mr", "max_tokens": "mt"})

    s = state.drop("last_s").join(sums.withColumnRenamed("c", "own"), "run_id", "full").join(kept, "run_id", "left").join(wins, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    here = F.col("n").isNotNull()
    whole_tail = zero(F.col("tail")) + F.when(F.col("tail").isNull() & (F.col("good") == 0), zero(F.col("trailing"))).otherwise(0)
    out = s.select(
        "run_id", (zero("calls") + zero("n")).alias("calls"), (zero("cost") + zero("own")).cast("double").alias("cost"), F.when(here, whole_tail).otherwise(F.col("trailing")).alias("trailing"),
        F.greatest(zero("longest"), zero("most")).alias("longest"), F.coalesce("tripped_line", "tripped").alias("tripped_line"), F.coalesce("stop_line", "stop").alias("stop_line"),
        F.greatest(zero("max_requests"), zero("mr")).alias("max_requests"), F.greatest(zero("max_tokens"), zero("mt")).alias("max_tokens"), "last_s",
        F.coalesce("new", "recent", F.array().cast("array<struct<ts:long,r:long,t:long>>")).alias("recent"),
    )
    done = cut(out, "state")
    drop_paths(state.sparkSession, rows, d, seconds_)
    return done


def state_after(spark: SparkSession, out_path: str, number: int) -> DataFrame:
    """The state that the batch ``number`` wrote; none before the first."""
    return spark.createDataFrame([], STATE) if number < 0 else spark.read.schema(STATE).parquet(f"{out_path}/batch={number}")


def live_limits(results: DataFrame, out_path: str, checkpoint: str, threshold: int = 20, cost_limit: float = float("inf"), concurrency: int = 1, seconds: int = 60) -> StreamingQuery:
    """Keep the state of each run (see next_state) of a stream of results, in a folder for each micro-batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = next_state(state_after(spark, out_path, number - 1), batch, threshold, cost_limit, concurrency, seconds)
        state.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        drop_paths(spark, state)

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
