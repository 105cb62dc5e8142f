"""Agreement of runs over (run_id, study_uid, decision)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import landis_koch


def _kappa(po: Column, pe: Column) -> Column:
    """Kappa of observed and expected agreement; where chance explains all, 1 if all agree, else 0."""
    return F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def pairwise(decisions: DataFrame) -> DataFrame:
    """Every pair of runs over the records both decided: n, share of agreement, Cohen's kappa and its label.

    A pair without a common record has n 0, agreement 0 and no kappa. The records' decisions meet once per pair of runs; from there on only
    category counts are handled.
    """
    a, b = (decisions.select("study_uid", F.col("run_id").alias(f"run_{s}"), F.col("decision").alias(f"d_{s}")) for s in "ab")
    cells = a.join(b, "study_uid").where("run_a < run_b").groupBy("run_a", "run_b", "d_a", "d_b").agg(F.count("*").alias("n"))
    total = cells.groupBy("run_a", "run_b").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("d_a") == F.col("d_b"), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy("run_a", "run_b", F.col("d_a").alias("d")).agg(F.sum("n").alias("na"))
    right = cells.groupBy("run_a", "run_b", F.col("d_b").alias("d")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, ["run_a", "run_b", "d"]).groupBy("run_a", "run_b").agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    runs = decisions.select("run_id").distinct()
    pairs = runs.select(F.col("run_id").alias("run_a")).join(runs.select(F.col("run_id").alias("run_b")), F.col("run_a") < F.col("run_b"))  # a row for each pair of runs
    d = pairs.join(total, ["run_a", "run_b"], "left").join(chance, ["run_a", "run_b"], "left")
    po = F.col("same") / F.col("total")
    pe = F.coalesce("chance", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    kappa = F.when(F.col("total") > 0, F.round(_kappa(po, pe), 6))
    d = d.select("run_a", "run_b", F.coalesce("total", F.lit(0)).alias("n"), F.coalesce(F.round(po, 6), F.lit(0.0)).alias("agreement"), kappa.alias("kappa"))
    return d.withColumn("label", landis_koch(F.col("kappa")))


def comparison(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The comparison of all runs: one row (n_runs, n_common, fleiss_kappa, fleiss_label, n_unstable), the pairs, and the unstable records."""
    fixed = unstable(decisions)
    one = fleiss(decisions).select(F.col("n").alias("n_common"), F.col("kappa").alias("fleiss_kappa"), landis_koch(F.col("kappa")).alias("fleiss_label"))
    runs = decisions.agg(F.count_distinct("run_id").alias("n_runs"))
    row = runs.crossJoin(one).crossJoin(fixed.agg(F.count("*").alias("n_unstable")))  # one row each
    return row.select("n_runs", "n_common", "fleiss_kappa", "fleiss_label", "n_unstable"), pairwise(decisions), fixed


def common(decisions: DataFrame) -> DataFrame:
    """The decisions on records that every run decided."""
    runs = decisions.select("run_id").distinct().count()
    all_ = decisions.groupBy("study_uid").agg(F.count_distinct("run_id").alias("r")).where(F.col("r") == runs).select("study_uid")
    return decisions.join(all_, "study_uid", "left_semi")


def fleiss(decisions: DataFrame) -> DataFrame:
    """Fleiss' kappa over the records that every run decided, in one row: n, raters, kappa."""
    d = common(decisions)
    cells = d.groupBy("study_uid", "decision").agg(F.count("*").cast("double").alias("x"))
    items = cells.groupBy("study_uid").agg(F.sum("x").alias("r"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    po = items.agg(F.count("*").alias("n"), F.max("r").alias("raters"), F.avg((F.col("xx") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("po"))
    shares = cells.groupBy("decision").agg(F.sum("x").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("t"), F.count("*").alias("cats"))
    both = po.crossJoin(shares)  # one row each
    pe = F.col("ss") / (F.col("t") * F.col("t"))
    kappa = F.when(F.col("n") == 0, None).when(F.col("cats") < 2, 1.0).otherwise(_kappa(F.col("po"), pe))
    return both.select("n", F.coalesce(F.col("raters"), F.lit(0)).cast("long").alias("raters"), F.round(kappa, 6).alias("kappa"))


def unstable(decisions: DataFrame) -> DataFrame:
    """Records that every run decided and not all alike, with the decisions in order of the runs."""
    d = common(decisions).groupBy("study_uid").agg(F.count_distinct("decision").alias("k"), F.array_sort(F.collect_list(F.struct("run_id", "decision"))).alias("all"))
    return d.where("k > 1").select("study_uid", F.array_join(F.transform("all", lambda x: F.concat(x["run_id"], F.lit("="), x["decision"])), ";").alias("decisions"))


def majority(decisions: DataFrame) -> DataFrame:
    """Per record the decision that has more votes than any other, else NO_CONSENSUS."""
    votes = decisions.groupBy("study_uid", "decision").agg(F.count("*").alias("n"))
    d = votes.groupBy("study_uid").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "decision"))).alias("v"))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    return d.select("study_uid", F.when(second.isNull() | (first["n"] < second["n"]), first["decision"]).otherwise("NO_CONSENSUS").alias("decision"))


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """Metrics of a model's boolean column ``ai`` against ``human``; a share of nothing is 0."""
    d = pairs.agg(
        F.count_if(F.col("ai") & F.col("human")).alias("tp"), F.count_if(F.col("ai") & ~F.col("human")).alias("fp"),
        F.count_if(~F.col("ai") & ~F.col("human")).alias("tn"), F.count_if(~F.col("ai") & F.col("human")).alias("fn"),
    )
    share = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = (tp + fp + tn + fn).cast("double")
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return d.select(
        "tp", "fp", "tn", "fn", share(tp + tn, tp + fp + tn + fn).alias("accuracy"), share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"),
        share(tp, tp + fp).alias("precision"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.round(_kappa((tp + tn) / n, pe), 6).alias("kappa"),
    )


def discussion_consensus(opinions: DataFrame) -> DataFrame:
    """(study_uid, round, participant, decision) folded to the first round in which all agree, and rounds used."""
    rounds = opinions.groupBy("study_uid", "round").agg(F.count_distinct("decision").alias("k"), F.min("decision").alias("d"))
    agreed = F.when(F.col("k") == 1, F.col("round"))
    return rounds.groupBy("study_uid").agg(F.min(agreed).alias("consensus_round"), F.max("round").alias("last_round"), F.min_by("d", agreed).alias("decision"))
