"""What a user is told before an import and before a run: checks of files and of the whole project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.storage import cut

#: Share of records with an abstract below which a file or a source is warned of.
LEAST_SHARE = 0.6


def check_files(files: DataFrame, records: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(source_file, format, n, n_abstract, status, issue, error_code) of each file of (source_file, format), from the ``records`` read from them.

    Errors are UNSUPPORTED_TYPE (a kind of file that is told but not read: E101), PARSE_FAILED (one that is not told: E101), NO_RECORDS (E102) and NO_ABSTRACTS; LOW_ABSTRACT_RATIO is a
    warning. Nulls: a null format is one that is not told; records of files that are not listed are left out.
    """
    n = records.groupBy("source_file").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("n_abstract"))
    d = files.select("source_file", F.coalesce("format", F.lit("E101")).alias("format")).join(n, "source_file", "left").na.fill(0, ["n", "n_abstract"])
    issue = (
        F.when(F.col("format").isin("pdf", "xlsx", "zip"), "UNSUPPORTED_TYPE").when(F.col("format") == "E101", "PARSE_FAILED").when(F.col("n") == 0, "NO_RECORDS")
        .when(F.col("n_abstract") == 0, "NO_ABSTRACTS").when(F.col("n_abstract") < F.col("n") * least_share, "LOW_ABSTRACT_RATIO").otherwise("")
    )
    d = d.withColumn("issue", issue)
    code = F.when(F.col("issue").isin("UNSUPPORTED_TYPE", "PARSE_FAILED"), "E101").when(F.col("issue") == "NO_RECORDS", "E102")
    status = F.when(F.col("issue") == "", "OK").when(F.col("issue") == "LOW_ABSTRACT_RATIO", "WARNING").otherwise("ERROR")
    return d.select("source_file", F.when(~F.col("format").startswith("E"), F.col("format")).otherwise("").alias("format"), "n", "n_abstract", status.alias("status"), "issue", code.alias("error_code"))


def check_project(records: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row: records, duplicates, valid_for_model, retracted_included, by_reason and quality (maps of counts), sources (array, by name), status and issues.

    Records are read once: they are counted by source, reason and quality, and all figures come from these counts. Issues are NO_RECORDS and NOTHING_TO_SCREEN, which are
    errors, and LOW_ABSTRACT_RATIO (of a source), SUSPECT_ABSTRACTS and RETRACTED_INCLUDED, which are warnings. Nulls: a null reason or quality is none, a null source a
    source of its own; null marks are false.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    cells = records.groupBy("source_label", text("exclusion_reason").alias("reason"), text("abstract_quality").alias("quality")).agg(
        F.count("*").alias("n"), F.count_if(true("has_abstract")).alias("abstracts"), F.count_if(true("is_duplicate")).alias("duplicates"), F.count_if(true("is_retracted")).alias("retracted")
    )
    cells = cut(cells, "cells")
    few = F.col("with_abstract") / F.col("records") < least_share
    sources = cells.groupBy("source_label").agg(
        F.sum("n").alias("records"), F.sum("abstracts").alias("with_abstract"), F.sum("duplicates").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("n"))), F.lit(0)).alias("valid_for_model")
    ).withColumn("status", F.when(few, "WARNING").otherwise("OK"))
    listed = sources.agg(F.array_sort(F.collect_list(F.struct("source_label", "records", "with_abstract", "duplicates", "valid_for_model", "status"))).alias("sources"))
    counts = lambda c: cells.where(F.col(c) != "").groupBy(c).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = cells.agg(
        zero("n").alias("records"), zero("duplicates").alias("duplicates"), zero(F.when(F.col("reason") == "", F.col("n"))).alias("valid_for_model"),
        zero(F.when(F.col("reason") != "RETRACTED", F.col("retracted"))).alias("retracted_included"), zero(F.when(F.col("quality") == "suspect_concat", F.col("n"))).alias("_suspect"),
    )
    d = sums.crossJoin(listed).crossJoin(counts("reason").toDF("by_reason")).crossJoin(counts("quality").toDF("quality"))  # one row each
    issues = F.array_compact(F.array(
        F.when(F.col("records") == 0, "NO_RECORDS").when(F.col("valid_for_model") == 0, "NOTHING_TO_SCREEN"), F.when(F.exists("sources", lambda s: s["status"] == "WARNING"), "LOW_ABSTRACT_RATIO"),
        F.when(F.col("_suspect") > 0, "SUSPECT_ABSTRACTS"), F.when(F.col("retracted_included") > 0, "RETRACTED_INCLUDED"),
    ))
    status = F.when(F.arrays_overlap("issues", F.array(F.lit("NO_RECORDS"), F.lit("NOTHING_TO_SCREEN"))), "ERROR").when(F.size("issues") > 0, "WARNING").otherwise("OK")
    return d.withColumn("issues", issues).withColumn("status", status).drop("_suspect")
