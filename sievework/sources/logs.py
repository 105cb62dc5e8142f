"""Append-only JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id string, timestamp string, step string, event_type string, level string, message string, source_label string, run_id string, payload string"
RESULT_SCHEMA = (
    "study_uid string, run_id string, status string, error_code string, decision string, derived_decision string, consistent boolean, reasoning string, "
    "inclusion array<struct<criterion:string,verdict:string,note:string,quote:string>>, exclusion array<struct<criterion:string,verdict:string,note:string,quote:string>>, "
    "flags array<string>, attempts int, tokens_in long, tokens_out long, cost double, latency_s double, batch int"
)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files with ``source_file`` and ``line_no``; a torn last line is left out, a bad line elsewhere is an error (E404).

    Files are read by lines, in as many tasks as they have blocks, so a file may be of any size. ``line_no`` ascends with the lines of a file, with gaps:
    it is where a line's block begins and its place in the block.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    place = F.row_number().over(Window.partitionBy("source_file", "_start").orderBy("_row")) - 1
    lines = lines.withColumn("line_no", F.col("_start") + place).where(F.trim("line") != "")
    d = lines.withColumn("row", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    d = d.withColumn("_bad", F.col("row").isNull() | F.col("row._bad").isNotNull())
    ends = d.groupBy("source_file").agg(F.max("line_no").alias("_last"), F.min(F.when(F.col("_bad"), F.col("line_no"))).alias("_wrong"))
    wrong = ends.where("_wrong < _last").agg(F.min("_wrong").alias("_wrong"))
    message = F.concat(F.lit("E404: bad line at "), F.col("_wrong").cast("string"))
    checked = F.when(F.col("_wrong").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    names = [f.name for f in d.schema["row"].dataType.fields if f.name != "_bad"]
    good = d.crossJoin(F.broadcast(wrong)).where(checked).where("NOT _bad")  # one row
    return good.select("source_file", "line_no", *(f"row.{n}" for n in names))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(position, event_type, source_label, run_id, payload) of an event log, for :func:`sievework.operators.flow.event_numbers`."""
    d = read_log(spark, path, EVENT_SCHEMA)
    return d.select(F.col("line_no").alias("position"), "event_type", "source_label", "run_id", "payload")


def append_results(results: DataFrame, path: str) -> None:
    """Append results as JSON lines, one for each record; a file that was torn stays as it is and is read up to its last whole line."""
    results.write.mode("append").option("ignoreNullFields", False).json(path)


IMPORT_SCHEMA = "timestamp string, source_file string, sha256 string, source_label string, format string, records long, abstracts long, encoding string, notes array<string>, forced boolean"


def read_import_log(spark: SparkSession, path: str) -> DataFrame:
    """(log_file, line_no, ...) of the entries of an import log, as :func:`read_log` reads one; without a file there are none."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"log_file string, line_no long, {IMPORT_SCHEMA}")
    names = [c.split()[0] for c in IMPORT_SCHEMA.split(", ")]
    return read_log(spark, path, IMPORT_SCHEMA).toDF("log_file", "line_no", *names)


def not_imported_before(files: DataFrame, log: DataFrame, force: bool = False) -> DataFrame:
    """``files``, of which none has the checksum of an entry of the log: else an error (E106) that names the latest such entry. With ``force`` they are let pass.

    The error comes when the files are read. A null checksum is none; of entries with one checksum the last counts.
    """
    if force:
        return files
    last = log.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.max_by(F.struct("timestamp", "source_file", "source_label"), "line_no").alias("_before"))
    text = lambda c: F.coalesce(F.col(f"_before.{c}"), F.lit(""))
    message = F.concat(F.lit("E106: imported before, at "), text("timestamp"), F.lit(" as "), text("source_file"), F.lit(" ("), text("source_label"), F.lit(")"))
    checked = F.when(F.col("_before").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return files.join(last, "sha256", "left").where(checked).select(*files.columns)
