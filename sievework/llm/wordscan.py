"""Vectorised word scanning of Arrow string batches with numpy.

A batch of texts is one byte buffer. Words are found on the whole buffer at once, and each word
gets a 64-bit hash from its bytes, eight at a time, so no Python loop runs over words. Texts are taken in slices of a bounded number of bytes, so temporaries stay bounded
whatever the batch holds; one text longer than the bound is a slice by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE_BYTES = 1_500_000
#: Bytes from which a word is hashed, and compared, by itself.
LONG_WORD = 1024

_U = np.uint64
#: The low k bytes of a 64-bit integer, for k from 0 to 8.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit affects every output bit."""
    x = np.asarray(x, dtype=_U)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Scan:
    """Words of some texts: ``data`` their bytes, ``doc`` the text of each word (ascending), ``start``/``end`` its bytes, ``n_docs`` texts."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int
    lanes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lanes": None}  # made again where it is needed

    def _lanes(self) -> np.ndarray:
        """The eight bytes from each place on, as an integer; past the end they are 0."""
        if self.lanes is None:
            padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
            padded[: len(self.data)] = self.data
            self.lanes = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        return self.lanes

    def of(self, words: np.ndarray) -> Scan:
        """The words ``words`` (indexes) of this scan, in that order."""
        return Scan(self.data, self.offsets, self.start[words], self.end[words], self.doc[words], self.n_docs, self.lanes)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Of words of one length up to eight bytes no two have the same."""
        size = self.end - self.start
        lanes = self._lanes()
        with np.errstate(over="ignore"):
            out = mix(size.astype(_U) + _U(0x9E3779B97F4A7C15))
            out = mix(out ^ (lanes[self.start] & _LOW[np.minimum(size, 8)]))
            step, at = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
            while len(at):
                left = np.minimum(size[at] - step, 8)
                out[at] = mix(out[at] * _U(0x2545F4914F6CDD1D) ^ (lanes[self.start[at] + step] & _LOW[left]))
                step += 8
                at = at[size[at] > step]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def same(self, mine: np.ndarray, other: Scan, theirs: np.ndarray) -> np.ndarray:
        """Whether words of this scan (by index) have the bytes of words of another."""
        size = self.end[mine] - self.start[mine]
        same = size == other.end[theirs] - other.start[theirs]
        a, b, step = self._lanes(), other._lanes(), 0
        at = np.flatnonzero(same & (size <= LONG_WORD))
        while len(at):
            low = _LOW[np.minimum(size[at] - step, 8)]
            equal = (a[self.start[mine[at]] + step] & low) == (b[other.start[theirs[at]] + step] & low)
            same[at[~equal]] = False
            step += 8
            at = at[equal & (size[at] > step)]
        for i in np.flatnonzero(same & (size > LONG_WORD)).tolist():
            j, k = int(self.start[mine[i]]), int(other.start[theirs[i]])
            same[i] = np.array_equal(self.data[j : j + size[i]], other.data[k : k + size[i]])
        return same

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)

    def firsts(self) -> np.ndarray:
        """For each word, the index of the first word of its text."""
        c = self.counts()
        return np.repeat(np.cumsum(c) - c, c)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, bytes, offsets) of runs of whole texts with ``limit`` bytes at most, or one text; null is empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Scan:
    """Words of texts: runs of bytes that ``table`` maps to non-zero; the bytes of the result are mapped by ``table``, but for byte 0."""
    zero = np.flatnonzero(data == 0) if table[0] and not data.all() else None
    data = table[data]
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 0, out=inside[1:-1])
    # a text's first byte always starts anew, even if the text before ends with a word
    change = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    if len(both):
        both = np.unique(both)
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    doc = np.searchsorted(offsets[1:], starts, side="right")
    if zero is not None:
        data[zero] = 0
    return Scan(data, offsets, starts, ends, doc, len(offsets) - 1)


def byte_table(separators: str | bytes | None, keep: bytes | None = None) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("A") : ord("Z") + 1] += 32
    if keep is not None:
        t[~np.isin(t, np.frombuffer(keep, dtype=np.uint8))] = 0
    else:
        t[list(separators)] = 0
    t[0] = 0
    return t


#: Words ``[^\x20\x09-\x0D]+`` with A-Z in lower case; byte 0 is a word's byte like others, so it is not mapped to 0 here.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
SPACED[0] = 1
#: Words of letters, digits and non-ASCII bytes, A-Z in lower case.
ALNUM = byte_table(None, bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def distinct(s: Scan, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words ``at`` (indexes): one of each distinct word, and which of these each is. Words are told apart by their bytes."""
    if not len(at):
        return at, at
    _, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
    if s.same(at, s, at[first][which]).all():
        return at[first], which
    whole, seen = s.data.tobytes(), {}
    which = np.array([seen.setdefault(whole[a:b], len(seen)) for a, b in zip(s.start[at].tolist(), s.end[at].tolist(), strict=True)])
    return at[np.unique(which, return_index=True)[1]], which


def shingles(words: np.ndarray, s: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words and the text of each; a text of fewer words, but not none, is one run."""
    n = len(words)
    if not n:
        return words, s.doc
    counts = s.counts()
    first, size = s.firsts(), np.repeat(counts, counts)
    at = np.arange(n) - first
    whole = (at + k <= size) | (at == 0)
    h = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = np.zeros(n, dtype=_U)
            part[: max(n - j, 0)] = words[j:]
            live = at + j < size
            h = np.where(live, mix(h * _U(0x2545F4914F6CDD1D) + part + _U(j + 1)), h)
    return h[whole], s.doc[whole]
