"""Shared-folder and lineage helpers.

Intermediate results are cut from their lineage by writing them as Parquet below the folder that
the session names in ``spark.checkpoint.dir``: such a table survives the loss of any executor, is
columnar and compressed, and a stage that is run again reads it rather than its whole past.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of this machine only where the session names none and all runs on this machine (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    base = shared_dir(spark)
    if ":/" not in base:
        base = f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, without its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_paths(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` made and that are needed no more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the broadcasts and shuffles of plans that nobody holds any more: Spark cleans them when the driver collects its garbage.

    An iterative operator plans hundreds of small jobs, whose remains would fill the driver's heap before it does so by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows of (long, long) up to which a side may be broadcast: about 32 MB in each executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows of a few numbers at most; beyond that the join shuffles."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df
