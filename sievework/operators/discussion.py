"""Rounds of discussion between runs about disputed records, and runs of a model that marks records before screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.running import running
from sievework.operators.screening import free_records

#: Rounds of a discussion at most, and characters of a reason.
ROUNDS, REASONING = 3, 600


def discuss(opinions: DataFrame, max_rounds: int = ROUNDS, tie_break: str = "majority") -> DataFrame:
    """One row for each record of (study_uid, round, run_id, seat, label, decision, reasoning, error, tokens_in, tokens_out, cost).

    Round 0 has the opinions in dispute; ``seat`` orders the participants. In each round up to ``max_rounds`` a participant answers, and a call that failed (``error``), or
    that was not made, leaves its opinion as it was. The discussion ends with the first round from 1 on after which all opinions are one decision; answers of later
    rounds do not count. Without such a round a strict majority decides, if ``tie_break`` is majority, else NO_CONSENSUS.

    Gives decision, consensus, rounds_used, tie_break (null with consensus), reasoning, tokens and cost of the answers that count, source_decisions (map from run_id) and history
    (array of round, run_id, decision, reasoning, error, in order). Nulls: rows without study_uid or run_id are left out, and so are participants without an opinion
    in round 0; a cost is null if all are. Of several answers of a participant in a round the first by decision counts.
    """
    keys = ["study_uid", "run_id"]
    d = opinions.where("study_uid IS NOT NULL AND run_id IS NOT NULL").where(F.col("round").between(0, max_rounds))
    d = d.groupBy(*keys, "round").agg(F.min(F.struct("decision", "reasoning", "error", "seat", "label", "tokens_in", "tokens_out", "cost")).alias("a")).select(*keys, "round", "a.*")
    d = _seated(d, keys)
    grid = d.where("round = 0").select(*keys, "seat", "label", F.explode(F.sequence(F.lit(0), F.lit(max_rounds))).alias("round"))
    said = d.where("error IS NULL").select(*keys, "round", "decision", "reasoning")
    upto = Window.partitionBy(*keys).orderBy("round")
    held = lambda c: F.last(F.when(F.col("decision").isNotNull(), F.col(c)), ignorenulls=True).over(upto)
    state = grid.join(said, [*keys, "round"], "left").withColumns({"held": held("decision"), "why": held("reasoning")})
    rounds = state.groupBy("study_uid", "round").agg(
        F.count_distinct("held").alias("k"), F.array_sort(F.collect_list(F.struct("seat", "run_id", F.coalesce("label", F.lit("")).alias("label"), "held", F.coalesce("why", F.lit("")).alias("why")))).alias("seats")
    )
    agreed = F.min(F.when((F.col("k") == 1) & (F.col("round") > 0), F.col("round")))
    ends = rounds.groupBy("study_uid").agg(agreed.alias("agreed")).withColumn("rounds_used", F.coalesce("agreed", F.lit(max_rounds)))
    last = rounds.join(ends, "study_uid").where(F.col("round") == F.col("rounds_used")).drop("round", "k")
    votes = state.join(ends, "study_uid").where(F.col("round") == F.col("rounds_used")).groupBy("study_uid", "held").agg(F.count("*").alias("n"))
    best = votes.groupBy("study_uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "held"))).alias("v"))
    counted = d.join(ends, "study_uid").where(F.col("round") <= F.col("rounds_used"))
    entry = F.struct("round", "seat", "run_id", F.when(F.col("error").isNull(), F.col("decision")).alias("decision"), F.when(F.col("error").isNull(), F.col("reasoning")).alias("reasoning"), "error")
    told = counted.groupBy("study_uid").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("seat")).alias("history"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("round") == 0, F.struct("run_id", "decision"))))).alias("source_decisions"),
        *(F.coalesce(F.sum(F.when((F.col("round") > 0) & F.col("error").isNull(), F.col(c))), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")), F.sum(F.when((F.col("round") > 0) & F.col("error").isNull(), F.col("cost"))).alias("cost"),
    )
    d = last.join(best, "study_uid").join(told, "study_uid")
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    strict = (F.lit(tie_break) != "no_consensus") & (second.isNull() | (first["m"] < second["m"]))
    consensus = F.col("agreed").isNotNull()
    reasons = F.array_join(F.array_distinct(F.transform("seats", lambda s: F.concat(s["label"], F.lit(": "), s["why"]))), "; ")
    apart = F.concat(F.lit("No consensus after "), F.col("rounds_used").cast("string"), F.lit(" round(s). "), F.array_join(F.transform("seats", lambda s: F.concat(s["label"], F.lit(": "), s["held"])), "; "))
    return d.select(
        "study_uid", F.when(consensus | strict, first["held"]).otherwise("NO_CONSENSUS").alias("decision"), consensus.alias("consensus"), "rounds_used",
        F.when(~consensus, F.when(strict, "majority").otherwise("no_consensus")).alias("tie_break"), F.substring(F.when(consensus, reasons).otherwise(apart), 1, REASONING).alias("reasoning"),
        "tokens_in", "tokens_out", "cost", "source_decisions", "history",
    )


def _seated(d: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of participants with an opinion in round 0, with the seat and label that they have there."""
    seats = d.where("round = 0 AND decision IS NOT NULL").select(*keys, "seat", "label")
    return d.drop("seat", "label").join(seats, keys)


def prefilter_run(records: DataFrame, answers: DataFrame, model: str, floor: float = 0.9, max_cost: float | None = None, threshold: int = 5, concurrency: int = 1) -> tuple[DataFrame, DataFrame]:
    """(records, summary) after a run of a model over the records that have no reason yet and a title or an abstract.

    ``answers`` has (study_uid, line_no, error, model, probability_true, probability_false, confidence, cost, tokens_in, tokens_out) in the order in which calls ended. The run stops
    at the ``threshold``-th failure in a row, or where the cost so far reaches ``max_cost``; the calls in flight then, ``concurrency`` - 1, still end and count, and what
    later answers would do is not done. A record is marked AI_PREFILTER_JEV if it is out of scope rather than not, with a confidence of ``floor`` or more; the model's figures go into the object
    ``jev`` of its extra_json, whose other members stay.

    The summary is one row: eligible, checked (answers that count and did not fail), marked, cost, stop_line (null if the run did not stop). Stretches of the answers are summed apart, so
    a run is many tasks. Nulls: an answer without a record does nothing but count; a null cost is 0. Of several answers for a record the last that counts marks it.
    """
    d = answers.select("*", F.lit(0).alias("_run"), F.when(F.col("error").isNull(), 0).otherwise(1).alias("_bad"), F.when(F.col("error").isNull(), F.coalesce("cost", F.lit(0.0))).otherwise(0.0).alias("_cost"))
    d = running(d, "line_no", {"_spent": "_cost", "_failed": "_bad", "_good": F.when(F.col("error").isNull(), 1).otherwise(0)}, key="_run")
    begun = d.where("_bad = 1").groupBy("_good").agg(F.min("_failed").alias("_first"))
    broken = d.where("_bad = 1").join(begun, "_good").where(F.col("_failed") - F.col("_first") + 1 >= threshold).agg(F.min("line_no").alias("line")) if threshold > 0 else d.limit(0).agg(F.min("line_no").alias("line"))
    spent = d.where((F.col("_bad") == 0) & (F.col("_spent") >= (F.lit(None) if max_cost is None else F.lit(max_cost)))).agg(F.min("line_no").alias("line"))
    stop = broken.union(spent).agg(F.min("line").alias("stop_line"))
    rank = running(d.select("_run", "line_no"), "line_no", {"_k": 1}, key="_run").drop("_run")
    last = rank.crossJoin(F.broadcast(stop)).where("stop_line IS NOT NULL AND line_no <= stop_line").agg((F.max("_k") + concurrency - 1).alias("_last"))  # one row
    counted = d.join(rank, "line_no").crossJoin(F.broadcast(last)).where("_last IS NULL OR _k <= _last").where("_bad = 0")
    free = records.where(free_records())
    marks = counted.where((F.col("probability_true") > F.col("probability_false")) & (F.col("confidence") >= floor)).groupBy("study_uid").agg(F.max_by(F.struct("model", "probability_true", "probability_false", "confidence", "cost", "tokens_in", "tokens_out"), "line_no").alias("_jev"))
    marked = records.join(marks, "study_uid", "left")
    hit = F.col("_jev").isNotNull() & free_records()
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    details = F.concat(F.lit(f"Jev ({model}): p(exclude)="), two(F.col("_jev.probability_true")), F.lit(", confidence="), two(F.col("_jev.confidence")))
    own = F.coalesce(F.from_json(F.when(F.trim("extra_json") == "", "{}").otherwise(F.col("extra_json")), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    merged = F.to_json(F.map_concat(F.map_filter(own, lambda k, _: k != "jev"), F.create_map(F.lit("jev"), F.parse_json(F.to_json("_jev")))))
    marked = marked.withColumns({
        "extra_json": F.when(hit, merged).otherwise(F.col("extra_json")), "exclusion_details": F.when(hit, details).otherwise(F.col("exclusion_details")),
        "exclusion_reason": F.when(hit, "AI_PREFILTER_JEV").otherwise(F.col("exclusion_reason")),
    }).select(*records.columns)
    sums = counted.agg(F.count("*").alias("checked"), F.coalesce(F.sum("_cost"), F.lit(0.0)).alias("cost"))
    out = free.agg(F.count("*").alias("eligible")).crossJoin(sums).crossJoin(free.join(marks, "study_uid").agg(F.count("*").alias("marked"))).crossJoin(stop)  # one row each
    return marked, out.select("eligible", "checked", "marked", "cost", "stop_line")
