"""Tables of earlier runs and exports, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.results import OUTCOMES
from sievework.schemas import BOOLEANS, RECORD_COLUMNS, spark_type


def read_legacy_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, study_uid, decision) of run files with ``;`` between columns study_uid and label (1 or 0); the run's tag is in the file name."""
    d = spark.read.option("header", True).option("sep", ";").csv(path)
    missing = {"study_uid", "label"} - set(d.columns)
    if missing:
        raise ValueError(f"E203: no column {', '.join(sorted(missing))}")
    run = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9]+)", 1)
    label = F.expr("try_cast(label AS INT)")
    return d.select(run.alias("run_id"), "study_uid", F.when(label == 1, "INCLUDE").when(label == 0, "EXCLUDE").alias("decision")).where("decision IS NOT NULL")


def read_records_table(spark: SparkSession, path: str) -> DataFrame:
    """A records table from its CSV files. Other columns, or another order, are an error (E404), as are rows of another width and booleans other than true, false and nothing."""
    first = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if first.columns != RECORD_COLUMNS:
        raise ValueError("E404: not the columns of a records table")
    text = ", ".join(f"{c} string" for c in RECORD_COLUMNS)
    d = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("nullValue", "\1").option("emptyValue", "").csv(path)

    def typed(c: str) -> Column:
        v = F.coalesce(F.col(c), F.lit(""))
        if c in BOOLEANS:
            return F.when(v.isin("true", "false", ""), v == "true").otherwise(F.raise_error(F.concat(F.lit(f"E404: {c} is "), v)).cast("boolean"))
        return v if spark_type(c) == "string" else F.nullif(v, F.lit("")).cast(spark_type(c))

    return d.select(*(typed(c).alias(c) for c in RECORD_COLUMNS))


def number(c: Column) -> Column:
    """A number with decimal point or comma, or null."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def boolean(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.isin("true", "yes", "ja", "1"), True).when(v.isin("false", "no", "nein", "0"), False)


def read_result_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """An exported results table with typed columns; an apostrophe before a formula goes. An unknown outcome is an error (E203)."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)
    if not {"outcome", "decision"} & set(d.columns):
        raise ValueError("E203: no column outcome or decision")
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^'(?=[=+\-@])", "")
    outcome = F.upper(F.trim(text("outcome" if "outcome" in d.columns else "decision")))
    known = F.when(outcome.isin(*OUTCOMES), outcome).otherwise(F.raise_error(F.concat(F.lit("E203: unknown outcome "), outcome)))
    kinds = {"year": lambda c: number(F.col(c)).cast("int"), "tokens_in": lambda c: number(F.col(c)).cast("long"), "tokens_out": lambda c: number(F.col(c)).cast("long"), "cost": lambda c: number(F.col(c)), "latency_s": lambda c: number(F.col(c)), "consistent": lambda c: boolean(F.col(c))}
    return d.select(*(kinds.get(c, text)(c).alias(c) for c in d.columns if c != "outcome"), known.alias("outcome"))


def full_outer_runs(decisions: DataFrame, runs: list[str]) -> DataFrame:
    """One column for each run, a row for each record that any run has."""
    return decisions.groupBy("study_uid").pivot("run_id", runs).agg(F.first("decision"))
