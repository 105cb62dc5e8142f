"""Data sources that read byte ranges of text files: whole records of bibliographic files, and the lines of growing logs.

``tagged_text`` cuts RIS, MEDLINE and BibTeX files into ranges that tasks read by themselves. A record belongs to the range that its first line begins in; a task reads on behind its
range until another record begins, so a file of any size is many tasks. ``log_lines`` is a stream whose offset says how many bytes of each file have been read; a last line
that is not whole yet waits for the next batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sievework.sources.files import SNIFF_BYTES, detect

#: Bytes of a file's range, and of the records in a row, about.
RANGE_BYTES, ROW_BYTES = 32 << 20, 1 << 20
#: Lines at which a record of each format surely begins, whatever stands before.
STARTS = {"ris": rb"TY {1,2}-", "nbib": rb"PMID *-", "bib": rb"[ \t]*@[A-Za-z]+[ \t]*[{(]"}
_BLOCK = 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or of a path of this machine."""
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path: a file, the files in a folder, or those of names with ``*``; names that begin with a dot or an underscore are left out."""
    fs, at = opened(path)
    folder, _, name = at.rstrip("/").rpartition("/")
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    pattern = "*"
    if info.type != pafs.FileType.Directory:
        folder, pattern = folder or "/", name
    else:
        folder = at.rstrip("/")
    prefix = path.rstrip("/")[: len(path.rstrip("/")) - len(at.rstrip("/"))] if path.rstrip("/").endswith(at.rstrip("/")) else ""
    like = re.compile(".*".join(re.escape(x) for x in pattern.split("*")))
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and like.fullmatch(f.base_name) and f.base_name[0] not in "._")


@dataclass
class ByteRange(InputPartition):
    """A range of a file: its bytes from ``begin`` up to ``end``."""

    path: str
    begin: int
    end: int
    size: int
    kind: str = ""

    def __init__(self, path: str, begin: int, end: int, size: int, kind: str = "") -> None:
        super().__init__((path, begin, end))
        self.path, self.begin, self.end, self.size, self.kind = path, begin, end, size, kind


class TaggedText(DataSource):
    """(source_file, format, start, content): runs of whole records of RIS, MEDLINE and BibTeX files; files of other kinds give one row without content."""

    @classmethod
    def name(cls) -> str:
        return "tagged_text"

    def schema(self) -> str:
        return "source_file string, format string, start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TaggedReader(self.options)


class TaggedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes, self.row_bytes = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("rowBytes", ROW_BYTES))

    def partitions(self) -> list[ByteRange]:
        found = []
        for path, size in listed(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                head = f.read(SNIFF_BYTES)
            kind, _ = detect(path.rsplit("/", 1)[-1], head)
            wide = head[:2] in (b"\xff\xfe", b"\xfe\xff")  # two bytes a character: read as a whole
            step = self.range_bytes if kind in STARTS and not wide else max(size, 1)
            found += [ByteRange(path, a, min(a + step, size), size, kind + ("*" if wide else "")) for a in range(0, max(size, 1), step)]
        return found

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        name, kind = partition.path.rsplit("/", 1)[-1], partition.kind.rstrip("*")
        if kind not in STARTS:
            yield name, kind, 0, None
            return
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            if partition.kind.endswith("*"):
                yield name, kind, 0, f.read()
                return
            start = re.compile(rb"(?:^|(?<=[\r\n]))" + STARTS[kind])
            # one byte more before the range tells whether a line begins with it
            base = max(partition.begin - 1, 0)
            data = f.read_at(partition.end - base, base)
            begins = [m.start() for m in start.finditer(data) if base + m.start() >= partition.begin and (m.start() or not base)]
            # a start may be cut by the range's end; what follows is read until a record begins behind the end
            end = None
            while end is None and base + len(data) < partition.size:
                seen = len(data)
                data += f.read_at(min(_BLOCK, partition.size - base - seen), base + seen)
                for m in start.finditer(data, max(0, seen - _BLOCK)):
                    if m.start() and base + m.start() < partition.end and m.start() not in begins and base + m.start() >= partition.begin:
                        begins.append(m.start())
                    elif base + m.start() >= partition.end and m.end() < len(data):
                        end = m.start()
                        break
            end = len(data) if end is None else end
            if not base:
                begins = sorted({0, *begins})
            begins.sort()
            at = 0
            while at < len(begins):
                k = at + 1
                while k < len(begins) and begins[k] - begins[at] < self.row_bytes:
                    k += 1
                yield name, kind, base + begins[at], data[begins[at] : begins[k] if k < len(begins) else end]
                at = k


def read_chunks(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(source_file, format, start, text) of the records of RIS, MEDLINE and BibTeX files, some in a row, for the readers of :mod:`sievework.sources.files`.

    A file's bytes are UTF-8 if all its rows are, else Windows-1252 if all can be, else Latin-1, as when it is read whole. Other files have one row without text.
    """
    spark.dataSource.register(TaggedText)
    d = spark.read.format("tagged_text").option("path", path).option("rangeBytes", range_bytes).option("rowBytes", row_bytes).load()

    def can(code: str):
        @pandas_udf("boolean")
        def test(contents):
            return contents.map(lambda c: c is None or _decodes(c, code))

        return test("content")

    @pandas_udf(StringType())
    def text(contents, codes):
        return _pandas().Series([None if c is None else _text(c, k) for c, k in zip(contents, codes, strict=True)])

    codes = d.groupBy("source_file").agg(F.when(F.min(can("utf-8")), "utf-8").when(F.min(can("cp1252")), "cp1252").otherwise("latin-1").alias("code"))
    return d.join(codes, "source_file").select("source_file", "format", "start", text("content", "code").alias("text"))


def _pandas():
    import pandas

    return pandas


def _decodes(content: bytes, code: str) -> bool:
    try:
        content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") and code == "utf-8" else code)
        return True
    except UnicodeDecodeError:
        return False


def _text(content: bytes, code: str) -> str:
    if content[:2] in (b"\xff\xfe", b"\xfe\xff") and code == "utf-8":
        code = "utf-16"
    return content.decode("utf-8-sig" if code == "utf-8" else code).replace("\r\n", "\n").replace("\r", "\n")


class LogLines(DataSource):
    """(source_file, position, line): the whole lines of files that only grow, as a stream; ``position`` is the byte that a line begins at."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "source_file string, position long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


class LogReader(DataSourceStreamReader):
    """The offset is a map from file to the byte behind its last whole line."""

    def __init__(self, options: dict) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in listed(self.path) if (end := _whole(path, size))}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [ByteRange(path, a, min(a + self.range_bytes, upto), upto) for path, upto in sorted(end.items()) for a in range(start.get(path, 0), upto, self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range; ``size`` is where the batch's last line ends."""
        fs, at = opened(partition.path)
        with fs.open_input_file(at) as f:
            base = max(partition.begin - 1, 0)
            data = f.read_at(partition.end - base, base)
            while not data.endswith(b"\n") and base + len(data) < partition.size:
                more = f.read_at(min(_BLOCK, partition.size - base - len(data)), base + len(data))
                data += more[: more.find(b"\n") + 1] if b"\n" in more else more
        at = data.find(b"\n") + 1 if base else 0
        if not base or at:
            lines = data[at:].split(b"\n")[:-1]
            places, place = [], base + at
            for x in lines:
                places.append(place)
                place += len(x) + 1
            yield pa.RecordBatch.from_arrays([pa.array([partition.path.rsplit("/", 1)[-1]] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array([x.rstrip(b"\r").decode("utf-8", "replace") for x in lines], pa.string())], names=["source_file", "position", "line"])


def _whole(path: str, size: int) -> int:
    """The byte behind the last line end in the first ``size`` bytes of a file."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        while size > 0:
            begin = max(0, size - _BLOCK)
            found = f.read_at(size - begin, begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return 0


def stream_log(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of a growing JSON log as a stream, with source_file and position: the same as those of its whole lines read at once, wherever the file was cut when a batch began.

    Blank lines are left out. A whole line that cannot be read is an error (E404), as it is in :func:`sievework.sources.logs.read_log`.
    """
    spark.dataSource.register(LogLines)
    lines = spark.readStream.format("log_lines").option("path", path).option("rangeBytes", range_bytes).load().where(F.trim("line") != "")
    d = lines.withColumn("row", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    message = F.concat(F.lit("E404: bad line at "), F.col("position").cast("string"), F.lit(" of "), F.col("source_file"))
    wrong = F.when(F.col("row").isNull() | F.col("row._bad").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    names = [f.name for f in d.schema["row"].dataType.fields if f.name != "_bad"]
    return d.where(wrong).select("source_file", "position", *(f"row.{n}" for n in names))
