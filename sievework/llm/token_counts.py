"""Token counts of documents in flat files of ids, by a scan for the end-of-document id.

A flat file is nothing but unsigned little-endian ids, each document followed by the end id; there is no
index. Files are cut into blocks at fixed places, whatever document lies there, so a file of any size is
counted by many tasks. A block's task searches it for the end id with numpy and keeps the distances between
finds; what stands before the first find and after the last is stitched to the neighbours by a prefix scan
over the blocks' totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.byte_bpe import default_vocabulary, read_ranks
from sievework.llm.files import opened, read_range, written
from sievework.llm.session import Batches, cut, documents, fresh_path, in_batches

#: Ids in a block of a scan.
BLOCK_IDS = 1 << 20
#: Bytes of a flat file after which a task begins another.
FILE_BYTES = 256 * 1024 * 1024

_CODERS: dict[tuple[str, str], object] = {}


def _coder(path: str, pattern: str):
    """The library's coder of a rank file, made once in each worker."""
    if (path, pattern) not in _CODERS:
        import tiktoken

        _CODERS[path, pattern] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _CODERS[path, pattern]


def write_flat_tokens(docs: DataFrame, folder: str, end: int = 50256, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to flat files in ``folder``; (file, ordinal, doc_id) of each document.

    ``ordinal`` counts the documents of a file from 0. Documents stay in the partitions they are in, so nothing is
    shuffled. Nulls: a null text is an empty document, just an end id; a null doc_id is kept. Repeated rows are
    written each; other columns are not read. An empty table writes no file.
    """
    path, pattern = (path, pattern) if path else default_vocabulary()

    def run(batches: Batches) -> Batches:
        coder, part, number = _coder(path, pattern), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype="<u2").tobytes()
        todo = ((batch.column("doc_id").slice(i, 500), batch.column("text").slice(i, 500)) for batch in batches for i in range(0, batch.num_rows, 500))
        piece = next(todo, None)
        while piece is not None:
            name, ordinal, size = f"part-{part:06d}-{number:05d}.u16", 0, 0
            placed = []
            with written(folder, name) as out:
                while piece is not None and size < FILE_BYTES:
                    ids_of, texts = piece
                    for t in texts.to_pylist():
                        ids = np.array(coder.encode_ordinary(t), dtype="<u2").tobytes() if t else b""
                        out.write(ids + tail)
                        size += len(ids) + 2
                    placed.append((ids_of, ordinal))
                    ordinal += len(ids_of)
                    piece = next(todo, None)
            number += 1
            for ids_of, first in placed:
                n = len(ids_of)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n)), ids_of], names=["file", "ordinal", "doc_id"])

    return cut(in_batches(docs.select("doc_id", "text"), run, "file string, ordinal long, doc_id long"), "placed")


def flat_blocks(spark: SparkSession, folder: str, block_ids: int = BLOCK_IDS, suffix: str = ".u16", width: int = 2) -> DataFrame:
    """(file, block, offset, length) of the blocks of all flat files in ``folder``, in bytes."""
    fs, path = opened(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    files = [(f.base_name, f.size) for f in found if f.base_name.endswith(suffix) and not f.base_name.startswith("_") and f.size]
    step = block_ids * width
    listed = spark.createDataFrame(files, "file string, size long")
    blocks = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))).alias("block"))
    offset = F.col("block") * step
    return blocks.select("file", "block", offset.alias("offset"), F.least(F.lit(step), F.col("size") - offset).alias("length"))


def count_tokens(spark: SparkSession, folder: str, end: int = 50256, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of each document in the flat files of ``folder``, end ids not counted.

    Ids after a file's last end id, if any, are one more document. An empty file, or folder, has no documents.
    """
    blocks = flat_blocks(spark, folder, block_ids, width=width)
    many = max(1, min(blocks.count(), 100_000))
    dtype = "<u2" if width == 2 else "<u4"

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(read_range(f"{folder}/{b['file']}", b["offset"], b["length"]), dtype=dtype)
                at = np.flatnonzero(ids == end)
                gaps = np.diff(at, prepend=-1) - 1
                left = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["file"]]), pa.array([b["block"]], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([left], pa.int64()), pa.array([gaps], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "left", "gaps"],
                )

    scanned = cut(in_batches(blocks.repartition(many), run, "file string, block long, ends long, left long, gaps array<long>"), "scanned")
    # the prefix scan: documents ended before a block, and ids left open by the blocks since the last end id
    order = Window.partitionBy("file").orderBy("block")
    totals = scanned.select("file", "block", "ends", "left").withColumn("done", F.sum("ends").over(order))
    run_of = F.when(F.col("ends") > 0, F.col("block"))
    totals = totals.withColumn("since", F.coalesce(F.last(run_of, ignorenulls=True).over(order), F.lit(-1).cast("long")))
    opened_by = Window.partitionBy("file", "since").orderBy("block")
    totals = totals.withColumn("open", F.sum("left").over(opened_by))
    totals = totals.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0).cast("long"))).withColumn("final", F.lead("block").over(order).isNull())
    stitched = scanned.select("file", "block", "gaps").join(totals.drop("left"), ["file", "block"])
    inner = stitched.select("file", (F.col("done") - F.col("ends")).alias("before"), "carry", F.posexplode("gaps").alias("k", "gap"))
    ended = inner.select("file", (F.col("before") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("gap") + F.col("carry")).otherwise(F.col("gap")).alias("n_tokens"))
    rest = stitched.where("final AND open > 0").select("file", F.col("done").alias("ordinal"), F.col("open").alias("n_tokens"))
    return ended.union(rest)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted in flat files of all documents."""
    folder = fresh_path(spark, "flat-tokens")
    placed = write_flat_tokens(documents(spark, sf_dir), folder)
    return count_tokens(spark, folder).join(placed, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
