"""The subpackage's tables, Arrow passes over texts, and the storage helpers it shares with the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.wordscan import text_slices
from sievework.storage import broadcast_if_small, cut, drop_paths, fresh_path, shared_dir

__all__ = ["broadcast_if_small", "cut", "documents", "drop_paths", "fresh_path", "in_batches", "row_slices", "set_aside", "shared_dir", "table", "unused_names", "with_columns"]

Batches = Iterator[pa.RecordBatch]

#: Bytes of rows in an Arrow batch; a longer row is a batch by itself.
BATCH_BYTES = 2 * 1024 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, whatever the rows hold; the worker gives its Arrow memory back at the end.

    The bound is a setting of the session that Spark reads when the result is computed, so it stays set. Columns whose names have dots or backticks, which
    mapInArrow does not take, bear others meanwhile.
    """
    odd = [c for c in df.columns if "`" in c or "." in c]
    plain = dict(zip(odd, unused_names(df, *(f"odd{k}" for k in range(len(odd)))), strict=True))
    if odd:
        for c, p in plain.items():
            schema = schema.replace(f"`{c.replace('`', '``')}` ", f"`{p}` ")
        return in_batches(df.withColumnsRenamed(plain), run, schema).withColumnsRenamed({p: c for c, p in plain.items()})
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def row_slices(batches: Batches, limit: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows whose texts have ``limit`` bytes at most, or of one row."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column(column), limit):
            yield batch.slice(i, n), data, offsets


def with_columns(df: DataFrame, more: str) -> str:
    """The schema of ``df`` and of ``more``, as text."""
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), more])


def set_aside(df: DataFrame, made: list[str]) -> dict[str, str]:
    """Other names for those columns of ``df`` that an operator would replace."""
    have = [c for c in made if c in df.columns]
    return dict(zip(have, unused_names(df, *(f"own{k}" for k in range(len(have)))), strict=True))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that ``df`` has not, in any case of letters."""
    have = {c.lower() for c in df.columns}
    return [next(n for k in range(1, len(have) + 2) if (n := "_" * k + name).lower() not in have) for name in names]
