"""Word counts of runs of texts, made inside a task before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sievework.llm.session import Batches
from sievework.llm.wordscan import Scan, distinct, mix, scan, text_slices

#: Bytes of text whose words are counted together; a longer text is taken by itself.
GROUP_BYTES = 6_000_000

_U = np.uint64


def gathered(batches: Batches, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def scans(batches: Batches, table: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Scan]]:
    """Runs of rows of about ``limit`` bytes of ``text``, or one row, their bytes as they are, and their words."""
    for batch in gathered(batches, limit):
        for i, n, data, offsets in text_slices(batch.column("text"), 2 * limit):
            yield batch.slice(i, n), data, scan(data, offsets, table)


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which of the distinct values each value is, and these; there are no nulls."""
    found = values.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys: the first place of each, their number, and of all keys which it is; and the distinct keys themselves."""
    values, first, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, n, which, values


@dataclass
class Words:
    """The words of a scan: ``hashes`` of each, ``clean`` the words joined by single spaces, and ``begin``/``end`` where each stands there."""

    scan: Scan
    hashes: np.ndarray
    clean: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def of_scan(s: Scan) -> Words:
        size = s.end - s.start
        end = np.cumsum(size + 1) - 1
        begin = end - size
        clean = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
        inside = np.zeros(len(s.data) + 1, dtype=np.int8)
        np.add.at(inside, s.start, 1)
        np.add.at(inside, s.end, -1)
        source = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        target = np.ones(len(clean), dtype=bool)
        target[end] = False
        clean[target] = s.data[source]
        return Words(s, s.hashes(), clean, begin, end)

    def numbered(self, at: np.ndarray) -> tuple[int, np.ndarray]:
        """How many distinct words are among the words ``at``, and which of these each is; words are told apart by their bytes."""
        first, which = distinct(self.scan, self.hashes, at)
        return len(first), which

    def strings(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from ``first`` to ``last`` (indexes), as text."""
        begin, size = self.begin[first], self.end[last] - self.begin[first]
        at = np.cumsum(size)
        flat = np.repeat(begin - (at - size), size) + np.arange(int(at[-1]) if len(at) else 0)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.append(0, at).astype(np.int64)), pa.py_buffer(self.clean[flat])]).cast(pa.string())


def chain(left: np.ndarray, right: np.ndarray, place: int) -> np.ndarray:
    """The hash of a longer run of words from that of a shorter one and its next word's."""
    with np.errstate(over="ignore"):
        return mix(left * _U(0x2545F4914F6CDD1D) + right + _U(place))
