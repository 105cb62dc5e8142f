"""A sink for results that takes each batch of a run once, whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sievework.sources.ranges import opened

#: The file that says that a batch is whole.
DONE = "_DONE"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (folder of a batch, hidden file, name it is to have)."""

    files: list[tuple[str, str, str]] = field(default_factory=list)


class ResultLog(DataSource):
    """JSON lines of results in a folder for each (run_id, batch): ``path``."""

    @classmethod
    def name(cls) -> str:
        return "result_log"

    def schema(self) -> str:
        return "run_id string, batch int, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("results are only appended")
        return ResultWriter(self.options["path"])


class ResultWriter(DataSourceWriter):
    """Tasks write hidden files; the commit names them, and marks a batch last of all. A batch that is marked already stays as it is, and an abort leaves nothing."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = opened(self.path)
        streams: dict[str, tuple] = {}
        try:
            for r in rows:
                if r["run_id"] is None or r["batch"] is None:
                    raise ValueError("a result without a run or batch has no place in the log")
                folder = f"run_id={r['run_id']}/batch={r['batch']}"
                if folder not in streams:
                    name = uuid.uuid4().hex
                    fs.create_dir(f"{root}/_parts", recursive=True)
                    streams[folder] = (name, fs.open_output_stream(f"{root}/_parts/{name}"))
                streams[folder][1].write(r["line"].encode() + b"\n")
        finally:
            for _, out in streams.values():
                out.close()
        return Written([(folder, name, f"part-{name}.jsonl") for folder, (name, _) in streams.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        for folder in sorted({f[0] for f in files}):
            own = [f for f in files if f[0] == folder]
            if fs.get_file_info(f"{root}/{folder}/{DONE}").type == pafs.FileType.File:
                self._drop(fs, root, own)
                continue
            # what a commit that did not end left behind
            for old in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
                fs.delete_file(old.path)
            fs.create_dir(f"{root}/{folder}", recursive=True)
            for _, hidden, name in own:
                fs.move(f"{root}/_parts/{hidden}", f"{root}/{folder}/{name}")
            with fs.open_output_stream(f"{root}/{folder}/{DONE}") as out:
                out.write(json.dumps({"files": [f[2] for f in own]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        self._drop(fs, root, [f for m in messages if m for f in m.files])

    @staticmethod
    def _drop(fs: pafs.FileSystem, root: str, files: list[tuple[str, str, str]]) -> None:
        for _, hidden, _ in files:
            if fs.get_file_info(f"{root}/_parts/{hidden}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/_parts/{hidden}")


def append_batches(results: DataFrame, path: str) -> None:
    """Append results (with run_id and batch) to a log, each (run_id, batch) as one: one that the log has already changes nothing, one that was half written is written anew.

    All rows of a batch have to come in one call. A null run_id or batch is an error, and then nothing is written. Columns of any kind are kept, nulls too.
    """
    results.sparkSession.dataSource.register(ResultLog)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in results.columns)), {"ignoreNullFields": "false"})
    results.select("run_id", F.col("batch").cast("int").alias("batch"), line.alias("line")).write.format("result_log").option("path", path).mode("append").save()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the whole batches of a log."""
    fs, root = opened(path.rstrip("/"))
    done = [f.path.rpartition("/")[0] for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)) if f.base_name == DONE]
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(root)] if path.rstrip("/").endswith(root) else ""
    lines = spark.read.text([prefix + p for p in done], pathGlobFilter="part-*") if done else spark.createDataFrame([], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
