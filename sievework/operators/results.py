"""Results of model runs: last result of each record, the results table, comparison of runs, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import outcome
from sievework.operators.running import running
from sievework.storage import cut

DECISIONS = ["INCLUDE", "EXCLUDE", "UNCERTAIN"]
OUTCOMES = [*DECISIONS, "ERROR", "NOT_SCREENED", "PRE_EXCLUDED"]


def last_results(results: DataFrame) -> DataFrame:
    """The last line of each record in each run."""
    rest = [c for c in results.columns if c not in ("run_id", "study_uid")]
    last = results.groupBy("run_id", "study_uid").agg(F.max_by(F.struct(*rest), "line_no").alias("r"))
    return last.select("run_id", "study_uid", "r.*")


def results_table(records: DataFrame, results: DataFrame) -> DataFrame:
    """Every record with its last result of one run, and its outcome."""
    last = last_results(results).drop("run_id")
    d = records.join(last, "study_uid", "left")
    return d.select(
        "study_uid", "source_label", "year", "title", "abstract", outcome(F.col("exclusion_reason"), F.col("status"), F.col("decision")).alias("outcome"), "exclusion_reason",
        F.coalesce("status", F.lit("")).alias("status"), F.coalesce("decision", F.lit("")).alias("decision"), "consistent", F.coalesce("flags", F.lit("")).alias("flags"),
        F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"), "cost", "latency_s", (F.col("batch") + 1).alias("batch"),
    )


def outcome_counts(table: DataFrame) -> DataFrame:
    """Records of each outcome, those without any included."""
    all_ = table.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return all_.join(table.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def outcomes_by(table: DataFrame, column: str) -> DataFrame:
    """Records of each outcome by a column; years outside 1000 to 3000 are left out."""
    d = table.where((F.col("year") > 1000) & (F.col("year") < 3000)) if column == "year" else table
    return d.groupBy(column, "outcome").agg(F.count("*").alias("n"))


def flag_counts(table: DataFrame) -> DataFrame:
    flags = F.filter(F.transform(F.split("flags", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return table.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def consistency_counts(table: DataFrame) -> DataFrame:
    """Among decided records: whether the decision follows from the criteria, does not, or is not known."""
    d = table.where(F.col("outcome").isin("INCLUDE", "EXCLUDE", "UNCERTAIN"))
    return d.groupBy(F.when(F.col("consistent"), "yes").when(~F.col("consistent"), "no").otherwise("unknown").alias("consistent")).agg(F.count("*").alias("n"))


def batch_totals(table: DataFrame) -> DataFrame:
    d = table.where(F.col("status") != "")
    return d.groupBy("batch").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"))


def word_histogram(table: DataFrame) -> DataFrame:
    """Records by words of the abstract, in bins of a width that makes about 25 of them, a multiple of ten."""
    words = F.size(F.filter(F.split(F.coalesce("abstract", F.lit("")), r"\s+"), lambda w: w != ""))
    d = table.select("outcome", words.alias("words")).where("NOT (outcome = 'PRE_EXCLUDED' AND words = 0)")
    width = d.agg(F.greatest(F.lit(10), F.ceil(F.max("words") / F.lit(25.0) / F.lit(10.0)) * 10).alias("width"))
    d = d.crossJoin(F.broadcast(width))  # one row
    return d.groupBy((F.floor(F.col("words") / F.col("width")) * F.col("width")).alias("bin"), "outcome").agg(F.count("*").alias("n"))


def latency_histogram(table: DataFrame) -> DataFrame:
    """(bin_start, bin_end, outcome, n): results by seconds, in bins a twentieth of the longest wide, to a tenth of a second and half a second at least."""
    d = table.where("latency_s IS NOT NULL").select("outcome", "latency_s")
    width = d.agg(F.greatest(F.lit(0.5), F.bround(F.max("latency_s") / 20, 1)).alias("width"))
    d = d.crossJoin(F.broadcast(width)).withColumn("k", F.floor(F.col("latency_s") / F.col("width")))  # one row
    bins = d.groupBy("k", "width", "outcome").agg(F.count("*").alias("n"))
    return bins.select(F.round(F.col("k") * F.col("width"), 2).alias("bin_start"), F.round((F.col("k") + 1) * F.col("width"), 2).alias("bin_end"), "outcome", "n")


def status_counts(table: DataFrame) -> DataFrame:
    """Records that were sent, by status."""
    return table.where("status <> ''").groupBy("status").agg(F.count("*").alias("n"))


def result_totals(table: DataFrame) -> DataFrame:
    """One row: records, those decided, tokens in and out, and cost (null if no record has one)."""
    return table.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome").isin(*DECISIONS)).alias("screened"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost"),
    )


def uncertain_records(table: DataFrame, at_most: int = 200) -> DataFrame:
    """The first undecided records, by study_uid. This is a report of a fixed length."""
    return table.where("outcome = 'UNCERTAIN'").orderBy("study_uid").limit(at_most).select("study_uid", "title", "year", "flags")


def comparable(results: DataFrame) -> DataFrame:
    """(run_id, study_uid, decision): the last results that can be compared, those that are good and decided."""
    good = (F.col("status") == "ok") & F.col("decision").isin(*DECISIONS)
    return last_results(results).where(good).select("run_id", "study_uid", "decision")


def resolvable_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The screening runs (kind full or sample) that have results."""
    return runs.where(F.col("kind").isin("full", "sample")).join(results.select("run_id").distinct(), "run_id", "left_semi")


def screening_totals(results: DataFrame) -> DataFrame:
    """(run_id, included, excluded, uncertain) of the last good results of each run, as a flow event has them."""
    d = last_results(results).where("status = 'ok'")
    return d.groupBy("run_id").agg(*(F.count_if(F.col("decision") == k).alias(a) for k, a in (("INCLUDE", "included"), ("EXCLUDE", "excluded"), ("UNCERTAIN", "uncertain"))))


def seeded_sample(table: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows chosen by a hash of the key and a seed, the same for the same seed whatever the partitions. This is a sampling operator."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    return table.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def compare_runs(records: DataFrame, decisions: DataFrame, runs: list[str]) -> DataFrame:
    """Every record with its decision in each run, and whether those that decided agree."""
    wide = decisions.where(F.col("run_id").isin(*runs)).groupBy("study_uid").pivot("run_id", runs).agg(F.first("decision"))
    d = records.select("study_uid").join(wide, "study_uid", "left")
    given = F.filter(F.array(*(F.col(r) for r in runs)), lambda x: x.isNotNull())
    n = F.size(given)
    agreement = F.when(n == 0, "").when(n < len(runs), "partial").when(F.size(F.array_distinct(given)) == 1, "unanimous").otherwise("split")
    return d.select("study_uid", *(F.coalesce(r, F.lit("")).alias(r) for r in runs), agreement.alias("agreement"))


def _placed(table: DataFrame, order: str) -> DataFrame:
    """``table`` with ``_at``: the place of each row in an order, from 0, nulls last.

    Rows are dealt by ranges, and that is cut: dealing again for the counts may draw other bounds, or merge other partitions.
    """
    by = F.col(order).asc_nulls_last()
    dealt = cut(table.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    d = dealt.join(F.broadcast(before), "_part")  # a row for each partition
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return d.withColumn("_at", at).drop("_part", "_before")


def systematic_sample(table: DataFrame, order: str, at_most: int = 2000) -> DataFrame:
    """Every k-th row in an order, with the least k that leaves ``at_most`` rows. This is a sampling operator."""
    n = table.count()
    stride = max(1, -(-n // at_most))
    if stride == 1:
        return table
    return _placed(table, order).where(F.col("_at") % stride == 0).drop("_at")


def failures_in_a_row(results: DataFrame, threshold: int = 20) -> DataFrame:
    """Per run: the longest run of failed calls in line order, and whether it reaches the threshold; runs without a failure are left out."""
    failed = F.col("status").isin("parse_error", "api_error", "truncated")
    d = running(results.select("run_id", "line_no", failed.alias("f"), F.when(failed, 0).otherwise(1).alias("good")), "line_no", {"island": "good"})
    islands = d.where("f").groupBy("run_id", "island").agg(F.count("*").alias("n"))
    return islands.groupBy("run_id").agg(F.max("n").alias("longest")).withColumn("tripped", F.col("longest") >= threshold)


def batch_check(results: DataFrame, planned: DataFrame, limit: float = 0.5, least: int = 5) -> DataFrame:
    """Per batch: planned, done, ok, errors and missing records, and whether the run should pause."""
    last = last_results(results).select("study_uid", "batch", "status")
    d = planned.select("study_uid", "batch").join(last.drop("batch"), "study_uid", "left").groupBy("batch").agg(
        F.count("*").alias("n_planned"), F.count("status").alias("n_done"), F.count_if(F.col("status") == "ok").alias("n_ok")
    )
    d = d.withColumns({"n_errors": F.col("n_done") - F.col("n_ok"), "n_missing": F.col("n_planned") - F.col("n_done")})
    return d.withColumn("pause", (F.col("n_done") >= least) & (F.col("n_errors") > F.col("n_done") * limit))


def latency_summary(results: DataFrame) -> DataFrame:
    """Per run: median latency, the value at position int(0.95 n) in ascending order, and results."""
    counts = results.where("latency_s IS NOT NULL").groupBy("run_id", "latency_s").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_id")
    d = counts.withColumn("upto", F.sum("n").over(w.orderBy("latency_s"))).withColumn("total", F.sum("n").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("latency_s")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    p95 = F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(0.95)))
    return d.groupBy("run_id").agg(((at(low) + at(high)) / 2).alias("median_s"), at(p95).alias("p95_s"), F.max("total").alias("n"))


def open_items(planned: DataFrame, results: DataFrame, retry_errors: bool = True) -> DataFrame:
    """The planned records that a resumed run still has to do: those without a result, or with ``retry_errors`` without a good one."""
    done = last_results(results)
    done = done.where("status = 'ok'") if retry_errors else done
    return planned.join(done.select("study_uid"), "study_uid", "left_anti")


def failed_results(results: DataFrame, at_most: int = 200) -> DataFrame:
    """The first records, by line, whose last result is not good. This is a report of a fixed length."""
    return last_results(results).where("status <> 'ok'").orderBy("line_no").limit(at_most).select("study_uid", "status", "line_no")


def disputed_items(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records on which runs that decided differ, with all opinions in order of the runs."""
    d = decisions.groupBy("study_uid").agg(F.min("decision").alias("low"), F.max("decision").alias("high"), F.array_sort(F.collect_list(F.struct("run_id", "decision"))).alias("opinions"))
    d = d.where("low <> high").select("study_uid", F.array_join(F.transform("opinions", lambda o: F.concat(o["run_id"], F.lit(": "), o["decision"])), "; ").alias("opinions"))
    return records.select("study_uid", "title").join(d, "study_uid")


def batches(planned: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """``planned`` with ``batch``: consecutive rows in an order, ``size`` at a time."""
    return _placed(planned, order).withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


#: Rows of a side with one title beyond which they are dealt into boxes, and tasks that the boxes are dealt to at most.
MATCH_ROWS, MATCH_TASKS = 2000, 4096


def title_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables (title, value) whose titles are equal but for case and outer spaces.

    A title of m and n rows has m n pairs. Where a side has more than MATCH_ROWS of them, its rows are dealt into boxes, and each box meets each box of the other side in a
    group of its own, so the pairs of one title are many tasks, whose number adaptive execution leaves as it is.
    """
    key = lambda d, s: cut(d.select(F.lower(F.trim("title")).alias("key"), F.col("value").alias(f"{s}_value")).where("key IS NOT NULL"), "titles")
    sides = {"left": key(left, "left"), "right": key(right, "right")}
    boxes = lambda s: sides[s].groupBy("key").agg(F.ceil(F.count("*") / MATCH_ROWS).cast("int").alias(f"{s}_boxes"))
    many = boxes("left").join(boxes("right"), "key").where("left_boxes > 1 OR right_boxes > 1").withColumn("id", F.monotonically_increasing_id())
    many = cut(many, "boxes")
    groups = many.agg(F.sum(F.col("left_boxes").cast("long") * F.col("right_boxes"))).first()[0]
    if not groups:
        return sides["left"].join(sides["right"], "key")

    def dealt(own: str, other: str, *more: str) -> DataFrame:
        d = sides[own].join(many, "key").withColumn(f"{own}_box", F.pmod(F.xxhash64(f"{own}_value"), f"{own}_boxes").cast("int"))
        d = d.select("id", *more, f"{own}_value", f"{own}_box", F.explode(F.sequence(F.lit(0), F.col(f"{other}_boxes") - 1)).alias(f"{other}_box"))
        return d.repartition(min(groups, MATCH_TASKS), "id", "left_box", "right_box")

    few = lambda s: sides[s].join(many.select("key"), "key", "left_anti")
    met = dealt("left", "right", "key").join(dealt("right", "left"), ["id", "left_box", "right_box"]).select("key", "left_value", "right_value")
    return few("left").join(few("right"), "key").unionByName(met)


def new_snapshots(events: DataFrame) -> DataFrame:
    """Snapshot events that say something new: not the same as the last of their kind, unless an import or deduplication came between."""
    mark = F.when(F.col("event_type").isin("SOURCE_IMPORTED", "DEDUP_WITHIN_SOURCE", "DEDUP_GLOBAL"), F.col("position"))
    # of each event: the last import or deduplication before it, and for each kind the last snapshot's place, from running maxima over stretches of the log
    kinds = ("PREFILTER", "VALIDITY")
    d = running(events.withColumn("_log", F.lit(1)), "position", {}, "_log", {"_mark": mark} | {f"_at_{k}": F.when(F.col("event_type") == k, F.col("position")) for k in kinds})
    d = d.where(F.col("event_type").isin(*kinds)).withColumn("_last", F.when(F.col("event_type") == kinds[0], F.col(f"_at_{kinds[0]}")).otherwise(F.col(f"_at_{kinds[1]}")))
    before = events.where(F.col("event_type").isin(*kinds)).select(F.col("position").alias("_last"), F.col("n").alias("_n"), F.col("m").alias("_m"))
    d = d.join(before, "_last", "left")
    same, quiet = (F.col("_n") == F.col("n")) & (F.col("_m") == F.col("m")), ~(F.col("_mark") > F.col("_last"))
    return d.where(~(F.coalesce(same, F.lit(False)) & F.coalesce(quiet, F.lit(True)))).select("position", "event_type", "n", "m")
