"""Token ids in sorted-string tables: shards of documents by key, with sparse index, Bloom filter and footer.

A shard is a file. Documents stand in ascending order of key in blocks of about ``BLOCK_BYTES``; a key is
stored as the length of what it shares with the key before and the rest. After the blocks come the
index (last key, offset and length of each block), the Bloom filter of all ids, and a footer of fixed
length that says where these begin. One lookup reads the footer, filter and index, then one block.

A key is the doc_id, a hash of the text and a number that no other row has, so rows that repeat a doc_id have keys of their own.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.files import opened, read_range, written
from sievework.llm.session import Batches, cut, documents, fresh_path, in_batches
from sievework.llm.wordscan import SPACED, scan, text_slices

BLOCK_BYTES = 64 * 1024
#: Bytes of ids in a shard.
SHARD_BYTES = 256 * 1024 * 1024
#: Bits of the Bloom filter for each key, and hashes: one lookup in a hundred of an absent key goes on to the index.
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"SSTOKEN1"
#: index offset, index length, filter offset, filter length, documents, ids, bytes of an id, magic
FOOTER = struct.Struct("<QQQQQQB8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<BQI")

#: Words remembered by a worker before the older half is forgotten.
_REMEMBERED = 220_000
#: Bytes of text encoded at once.
SLICE_BYTES = 3_000_000
_CLOSING = frozenset(b".,;:!?")
#: Words that the tokenizer's normaliser and pre-tokenizer leave as they are: lower-case letters of ASCII and Latin-1.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The characters by which byte-level vocabularies write bytes: printable ones themselves, the others from U+0100 on.
_BYTE_CHARS = {b: b if b in _SHOWN else 0x100 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}


def id_part(doc_id: int | None) -> bytes:
    """Bytes whose order is that of doc_ids, null first: the first part of a key."""
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_of(doc_id: int | None, content: int = 0, row: int = 0) -> bytes:
    """A key whose byte order is that of (doc_id, content, row)."""
    return id_part(doc_id) + struct.pack(">QQ", content + (1 << 63), row)


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _bloom_places(part: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(part), zlib.adler32(part[::-1]) * 2654435761 % (1 << 32) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes (key, ids) in ascending order of key to a stream, a block at a time."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.dtype = out, width, np.dtype("<u2") if width == 2 else np.dtype("<u4")
        self.at = self.n_docs = self.n_ids = 0
        self._index, self._block, self._last, self._parts = [], bytearray(), b"", []

    def _flush(self) -> None:
        if self._block:
            self.out.write(bytes(self._block))
            self._index.append(_INDEX.pack(len(self._last), self.at, len(self._block)) + self._last)
            self.at += len(self._block)
            self._block.clear()
            self._last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(self.dtype).tobytes()
        if len(self._block) + len(value) > BLOCK_BYTES:
            self._flush()
        shared = len(os.path.commonprefix([self._last, key]))
        self._block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self._last = key
        if not self._parts or self._parts[-1] != key[:9]:
            self._parts.append(key[:9])
        self.n_docs += 1
        self.n_ids += len(ids)

    def close(self) -> None:
        """Write what is left, the index, the filter and the footer."""
        self._flush()
        bits = max(64, len(self._parts) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for part in self._parts:
            for p in _bloom_places(part, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        packed = b"".join(self._index)
        self.out.write(packed)
        self.out.write(struct.pack("<Q", bits) + bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(packed), self.at + len(packed), 8 + len(bloom), self.n_docs, self.n_ids, self.width, MAGIC))


def _index(packed: bytes) -> list[tuple[bytes, int, int]]:
    out, i = [], 0
    while i < len(packed):
        n, at, size = _INDEX.unpack_from(packed, i)
        i += _INDEX.size
        out.append((packed[i : i + n], at, size))
        i += n
    return out


def _entries(block: bytes, width: int) -> Iterator[tuple[bytes, np.ndarray]]:
    dtype, i, key = np.dtype("<u2") if width == 2 else np.dtype("<u4"), 0, b""
    while i < len(block):
        shared, rest, size = _ENTRY.unpack_from(block, i)
        i += _ENTRY.size
        key = key[:shared] + block[i : i + rest]
        i += rest
        yield key, np.frombuffer(block, dtype, size // width, i)
        i += size


def _footer(tail: bytes) -> tuple:
    found = FOOTER.unpack(tail)
    if found[-1] != MAGIC:
        raise ValueError("not a whole shard of token ids")
    return found


def _opened_shard(uri: str) -> tuple:
    fs, path = opened(uri)
    return _footer(read_range(uri, fs.get_file_info(path).size - FOOTER.size, FOOTER.size))


def read_shard(uri: str) -> Iterator[tuple[bytes, np.ndarray]]:
    """All (key, ids) of a shard, read a block at a time."""
    index_at, index_size, _, _, _, _, width, _ = _opened_shard(uri)
    for _, at, size in _index(read_range(uri, index_at, index_size)):
        yield from _entries(read_range(uri, at, size), width)


def lookup(uri: str, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one document of a shard (of rows that repeat its id, the one numbered ``copy``), or None: filter, binary search of the index, one block."""
    index_at, index_size, bloom_at, bloom_size, _, _, width, _ = _opened_shard(uri)
    part = id_part(doc_id)
    bloom = read_range(uri, bloom_at, bloom_size)
    bits = struct.unpack_from("<Q", bloom)[0]
    if not all(bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(part, bits)):
        return None
    index = _index(read_range(uri, index_at, index_size))
    for _, at, size in index[bisect_left(index, part, key=lambda e: e[0]) :]:
        for key, ids in _entries(read_range(uri, at, size), width):
            if key[:9] == part:
                if not copy:
                    return ids
                copy -= 1
            elif key > part:
                return None
    return None


class WordEncoder:
    """Ids by a tokenizer file that drops white space and so treats each word apart; words recur, so they are remembered.

    The ids of a text are those of its words one after another only if the tokenizer's normaliser and pre-tokenizer never
    look across white space (``whole`` gives the library's own ids of a text, for tests).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array, end: int) -> Iterator[list[np.ndarray]]:
        """Lists of the texts' ids and the end id, as unsigned 32-bit integers; null is empty.

        The words of a slice of texts are told apart by a 64-bit hash, which is then checked against their bytes, so each is looked up
        once; the ids are then laid out by index arithmetic.
        """
        for _, n, data, offsets in text_slices(texts, SLICE_BYTES):
            s = scan(data, offsets, SPACED)
            _, first, which = np.unique(s.hashes(), return_index=True, return_inverse=True)
            if not s.same(np.arange(len(which)), s, first[which]).all():  # words that share a hash go one by one
                whole = data.tobytes()
                split = [whole[i:j].lower().split() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                known = self._known(set().union(*split))
                yield [np.frombuffer(b"".join(map(known.__getitem__, words)) + struct.pack("<I", end), dtype="<u4") for words in split]
                continue
            lower = s.data.tobytes()
            words = [lower[i:j] for i, j in zip(s.start[first].tolist(), s.end[first].tolist(), strict=True)]
            known = self._known(words)
            pieces = [known[w] for w in words] + [struct.pack("<I", end)]
            flat = np.frombuffer(b"".join(pieces), dtype="<u4")
            size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) // 4
            begin = np.cumsum(size) - size
            # the words of each text and its end, as indexes of pieces
            counts = s.counts()
            ends = np.cumsum(counts + 1) - 1
            order = np.full(len(which) + n, len(words), dtype=np.int64)
            inner = np.ones(len(order), dtype=bool)
            inner[ends] = False
            order[inner] = which
            length = size[order]
            stop = np.cumsum(length)
            ids = flat[np.repeat(begin[order] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
            yield np.split(ids, stop[ends][:-1])

    def _known(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The ids of the words, and of others, as bytes.

        A word that ends with one mark after plain letters is that mark after the rest: the pre-tokenizer splits there.
        """
        if len(self._new) > _REMEMBERED:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        asked, marked = set(), []
        for w in words:
            if w not in new:
                ids = old.get(w)
                if ids is not None:
                    new[w] = ids
                elif w[-1] in _CLOSING and _PLAIN.fullmatch(w, 0, len(w) - 1):
                    marked.append(w)
                    asked.update((w[:-1], w[-1:]))
                else:
                    asked.add(w)
        missing = []
        for w in asked:
            if w not in new:
                ids = old.get(w)
                if ids is not None:
                    new[w] = ids
                elif _PLAIN.fullmatch(w):
                    # straight to the merges: the steps before them would change nothing
                    ids = [t.id for t in self.model.tokenize(w.decode("latin-1").translate(_BYTE_CHARS))]
                    new[w] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    missing.append(w)
        for w, e in zip(missing, self.tokenizer.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False), strict=True):
            ids = e.ids
            new[w] = struct.pack(f"<{len(ids)}I", *ids)
        for w in marked:
            new[w] = new[w[:-1]] + new[w[-1:]]
        return new

    def whole(self, text: str, end: int) -> np.ndarray:
        """The library's ids of a whole text and the end id."""
        return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], dtype="<u4")


_LOADED: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_tables(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as shards in ``folder``; (shard, n_docs, n_ids) of each.

    Documents are dealt by ranges of doc_id, so shard names ascend with the ids. Each document's ids are followed by
    the id ``end``. Nulls: a null text is empty; a null doc_id comes first. Rows that repeat a doc_id are stored
    each, in order of a hash of the text, and may be dealt to several shards. A long text is one entry. Other
    columns are not read. An empty table writes no shard.
    """
    tokenizer = tokenizer or default_tokenizer()
    order = ["doc_id", "h", "m"]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Batches) -> Batches:
        encoder, part, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        rows = (
            (key_of(*key), ids)
            for batch in batches
            for key, ids in zip(
                zip(*(batch.column(c).to_pylist() for c in order), strict=True), (ids for encoded in encoder.encode(batch.column("text"), end) for ids in encoded), strict=True
            )
        )
        made = []
        row = next(rows, None)
        while row is not None:
            name = f"part-{part:06d}-{number:05d}.sst"
            with written(folder, name) as out:
                shard = ShardWriter(out, encoder.width)
                while row is not None and shard.at < SHARD_BYTES:
                    shard.add(*row)
                    row = next(rows, None)
                shard.close()
            made.append((name, shard.n_docs, shard.n_ids))
            number += 1
        names, n_docs, n_ids = zip(*made, strict=True) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n_docs, pa.int64()), pa.array(n_ids, pa.int64())], names=["shard", "n_docs", "n_ids"])

    return cut(in_batches(dealt, run, "shard string, n_docs long, n_ids long"), "shards")


def read_token_tables(folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards of ``folder``, from the files.

    ``start`` is the number of ids in all documents before it, in the order of keys. ``shards`` (shard, n_ids) gives what each
    shard adds; a shard is read by one task, a block at a time.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for name, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows, at = [], before
                for key, ids in read_shard(f"{folder}/{name}"):
                    rows.append((doc_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield _columns(rows)
                        rows = []
                if rows:
                    yield _columns(rows)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    _columns = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
    upto = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))  # a row for each SHARD_BYTES of ids
    many = max(1, min(shards.count(), 100_000))
    dealt = shards.select("shard", (upto - F.col("n_ids")).alias("before")).repartition(many)
    return in_batches(dealt, run, ", ".join(f"{n} long" for n in names))


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the shards written."""
    folder = fresh_path(spark, "token-tables")
    shards = write_token_tables(documents(spark, sf_dir), folder)
    if shards.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_tables(folder, shards)
