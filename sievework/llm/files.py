"""Files that tasks write next to each other in a shared folder, and byte ranges of them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI such as ``file:/x``, ``hdfs://h/x`` or ``s3://b/x``."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str, name: str):
    """A stream whose file appears as ``name`` in the folder ``uri`` when it is whole.

    It is written under a hidden name of its own first, so a task that is run again, or twice at once,
    leaves one whole file of that name.
    """
    fs, folder = opened(uri)
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(hidden) as out:
            yield out
        fs.move(hidden, f"{folder}/{name}")
    except BaseException:
        if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
            fs.delete_file(hidden)
        raise


def read_range(uri: str, offset: int, length: int) -> bytes:
    """Bytes of a file."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_whole(uri: str) -> bytes:
    """A file's bytes."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped, and so shared by the tasks of a machine, where the folder is mounted; else read."""
    fs, path = opened(uri)
    if isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).size:
        return np.memmap(path, dtype=dtype, mode="r")
    return np.frombuffer(read_whole(uri), dtype=dtype)
