"""Byte-level BPE encoding and decoding over a rank file, with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.session import Batches, documents, in_batches, with_columns

#: Single bits. A word of the lower bitmap has 256 bits; the summary has as many as there are words.
_BIT = [1 << i for i in range(4096)]
#: Stretches of text remembered by a task before the older half is forgotten, and the characters of the longest. They are cheap to make again.
_REMEMBERED, _LONGEST = 40_000, 64
#: Bytes of the longest pieces that are merged side by side, and pieces merged at once.
_WIDEST, _ABREAST = 64, 8192
#: Bits of a position in such a piece, and a number above all ranks with positions.
_PLACE, _NONE = 7, 2**62


class Pairs:
    """Ranks of two tokens' joined bytes, in a hash table of arrays with linear probing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.n = max(ranks.values()) + 2
        found = [(ranks[t[:k]] * self.n + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        keys, values = np.array(found, dtype=np.int64).reshape(-1, 2).T
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, -1, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at, first = np.unique(slot[todo], return_index=True)
            free = self.key[at] < 0
            put = todo[first[free]]
            self.key[slot[put]], self.rank[slot[put]] = keys[put], values[put]
            todo = todo[self.key[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if there is none."""
        keys = left.astype(np.int64) * self.n + right
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.rank[slot], -1)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self.key) - 1)
            there = self.key[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.rank[slot[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class ByteBPE:
    """Encoder and decoder of one rank table (bytes to id); every single byte must have an id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]
        self.alone = [np.int32(i).tobytes() for i in range(len(self.bytes_of))]
        self.marks = {c: self.alone[ranks[c.encode()]] for c in ".,;:!?"}
        self.pairs = Pairs(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self._new, self._old = {}, {}

    def encode_pretoken(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern: always the lowest rank first, of equal ranks the leftmost.

        The parts are a linked list. A bucket for each merge rank holds the positions whose pair has that
        rank, and a bitmap of two levels tells which buckets have any: find-first-set on the summary and
        then on one word gives the lowest rank. Entries that a neighbour's merge makes stale are left in
        their buckets, and skipped when they are met.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        get = ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair_rank = [-1] * n
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        bit = _BIT
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair_rank[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    words[w] = words.get(w, 0) | bit[r & 255]
                    summary |= bit[w]
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            low = bits & -bits
            rank = (w << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) == 1:
                i = bucket[0]
                del buckets[rank]
                words[w] = bits = bits ^ low
                if not bits:
                    summary ^= bit[w]
            else:
                i = heappop(bucket)
            if pair_rank[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            pair_rank[j] = -1
            pair_rank[i] = -1
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]])
                if r is not None:
                    pair_rank[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        w = r >> 8
                        words[w] = words.get(w, 0) | bit[r & 255]
                        summary |= bit[w]
            h = before[i]
            if h >= 0:
                r = get(piece[h:end])
                if r is None:
                    pair_rank[h] = -1
                else:
                    pair_rank[h] = r
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        w = r >> 8
                        words[w] = words.get(w, 0) | bit[r & 255]
                        summary |= bit[w]
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode_pretokens(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as 32-bit integers, of each match of the pattern: those of :meth:`encode_pretoken`, of many short pieces side by side."""
        whole = list(map(self.ranks.get, pieces))
        out = [b"" if r is None else self.alone[r] for r in whole]
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        size[[r is not None for r in whole]] = 0
        for k in np.flatnonzero(size > _WIDEST).tolist():
            out[k] = np.array(self.encode_pretoken(pieces[k]), dtype=np.int32).tobytes()
        size[size > _WIDEST] = 0
        order = np.argsort(size, kind="stable")
        ordered, i = size[order], int(np.count_nonzero(size == 0))
        while i < len(order):
            j = min(i + _ABREAST, int(np.searchsorted(ordered, max(8, ordered[i] * 3 // 2), side="right")))
            at = order[i:j].tolist()
            self._merge(at, [pieces[k] for k in at], out)
            i = j
        return out

    def _merge(self, at: list[int], pieces: list[bytes], out: list[bytes]) -> None:
        """Puts the ids of each piece into ``out``. Every turn makes one merge in each piece: of its lowest rank, the leftmost.

        A column is a piece, with a row for each byte and one more at either end. A row whose token was
        merged into the one before has token -1; rows outside the piece have a token that is in no pair. ``best`` has
        rank and place of the pair that begins in a row as one number, so the least of a column is the pair to merge.
        """
        wide, high, none = len(pieces), len(pieces[-1]) + 2, self.pairs.n - 1
        data = np.frombuffer(b"".join([p.ljust(high - 2, b"\0") for p in pieces]), dtype=np.uint8).reshape(wide, high - 2).T
        token = np.full((high, wide), none, dtype=np.int64)
        token[1:-1] = np.where(np.arange(high - 2)[:, None] < np.array([len(p) for p in pieces]), self.of_byte[data], none)
        place = np.arange(high)[:, None]
        after, before = np.repeat(place + 1, wide, axis=1), np.repeat(place - 1, wide, axis=1)
        best = np.full((high, wide), _NONE, dtype=np.int64)
        rank = self.pairs.of(token[1:-2].ravel(), token[2:-1].ravel()).reshape(high - 3, wide).astype(np.int64)
        best[1:-2] = np.where(rank < 0, _NONE, (rank << _PLACE) + place[1:-2])
        own = np.array(at)
        while True:
            least = best.min(axis=0)
            live = np.flatnonzero(least < _NONE)
            if 2 * len(live) <= len(own):
                over = np.flatnonzero(least == _NONE)
                ids = token[:, over].T
                kept = (ids >= 0) & (ids != none)
                flat, ends = ids[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for k, a, b in zip(own[over].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[a:b]
                if not len(live):
                    return
                token, after, before, best = (np.ascontiguousarray(x[:, live]) for x in (token, after, before, best))
                own, least, live = own[live], least[live], np.arange(len(live))
            least = least[live]
            merged, i, n = least >> _PLACE, least & ((1 << _PLACE) - 1), len(own)
            t, a, b, c = token.reshape(-1), after.reshape(-1), before.reshape(-1), best.reshape(-1)
            here = i * n + live
            j = a[here] * n + live
            end, h = a[j], b[here]
            t[here], t[j], a[here], c[j] = merged, -1, end, _NONE
            b[end * n + live] = i
            left = h * n + live
            rank = self.pairs.of(np.concatenate([merged, t[left]]), np.concatenate([t[end * n + live], merged])).astype(np.int64)
            key = np.where(rank < 0, _NONE, (rank << _PLACE) + np.concatenate([i, h]))
            c[here], c[left] = key[: len(live)], key[len(live) :]

    def _learn(self, stretches: set[str]) -> None:
        """Remembers the ids of stretches: one that begins with a space stands for what follows it, any other for itself after a space."""
        new, old, marks = self._new, self._old, self.marks
        again = old.keys() & stretches
        new.update({s: old[s] for s in again})
        words = {s for s in stretches - again if s.isalpha()}
        rest = stretches - again - words
        marked = [s for s in rest if s[-1] in marks and s[:-1].isalpha()]  # the pattern parts the mark from the letters
        words.update(w for w in [s[:-1] for s in marked] if w not in new)
        mixed = {s: self.split.findall(s[1:] if s[0] == " " else " " + s) for s in rest.difference(marked)}
        pieces = list({p for found in mixed.values() for p in found})
        ids = self.encode_pretokens([(" " + w).encode() for w in words] + [p.encode() for p in pieces])
        new.update(zip(words, ids))
        new.update({s: new[s[:-1]] + marks[s[-1]] for s in marked})
        of_piece = dict(zip(pieces, ids[len(words) :], strict=True))
        new.update({s: b"".join([of_piece[p] for p in found]) for s, found in mixed.items()})

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit integers.

        A single space followed by something else than white space always starts a match of
        the pattern, so a text is cut there and its stretches, which recur, are looked up; those not met before are
        merged together. A text where white space stands beside such a space goes through the pattern as a whole.
        """
        new = self._new
        cut = []
        for text in texts:
            parts = text.split(" ")
            parts[0] = " " + parts[0]
            cut.append(parts)
        wanted = set().union(*cut) - new.keys()
        odd = {s for s in wanted if not s or s.strip() != s}
        odd = {s for s in odd if s[:1] != " " or s[-1].isspace()}
        if odd:
            wanted -= odd
            for k, text in enumerate(texts):
                if not odd.isdisjoint(cut[k]):
                    cut[k] = [p[1:] if p[0] == " " and not p.isspace() else " " + p for p in self.split.findall(text)]
                    wanted.update(s for s in cut[k] if s not in new)
        self._learn(wanted)
        out = [b"".join(map(new.__getitem__, parts)) for parts in cut]
        for s in [s for s in wanted if len(s) > _LONGEST]:
            del new[s]
        if len(new) >= _REMEMBERED:
            self._old, self._new = new, {}
        return out

    def forget(self) -> None:
        """Forgets the stretches, so a worker that waits for other stages does not hold them."""
        self._new, self._old = {}, {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_all([text])[0], dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a rank file: a line holds base64 of a token's bytes and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The coder of a rank file, read once in each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids array<int>``, the token ids of ``text``; a column of that name is replaced.

    A null or empty text has no ids. Other columns, with nulls and whatever names, stay; repeated rows
    are encoded each. The rank file must lie at ``path`` on every executor. An empty table gives an empty one.
    """
    path, pattern = (path, pattern) if path else default_vocabulary()
    docs = docs.drop("ids")

    def run(batches: Batches) -> Batches:
        coder = loaded(path, pattern)
        for batch in batches:
            ids = coder.encode_all([t or "" for t in batch.column("text").to_pylist()])
            first = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(first), flat)], names=[*batch.schema.names, "ids"])
        coder.forget()

    return in_batches(docs, run, with_columns(docs, "ids array<int>"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of ``ids``; null ids give null. Other columns stay."""
    path, pattern = (path, default_vocabulary()[1]) if path else default_vocabulary()
    encoded = encoded.drop("decoded")

    def run(batches: Batches) -> Batches:
        coder = loaded(path, pattern)
        for batch in batches:
            out = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return in_batches(encoded, run, with_columns(encoded, "decoded binary"))


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without text, with n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of each text.

    Texts are encoded and the ids decoded in one pass, so neither leaves the task. A null text counts as
    empty: no ids, and the hash of nothing twice.
    """
    path, pattern = (path, pattern) if path else default_vocabulary()
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rest = docs.drop(*made)
    kept = rest.drop("text")
    names = kept.columns

    def run(batches: Batches) -> Batches:
        coder = loaded(path, pattern)
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for found in coder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(found, dtype=np.int32).tolist()
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(b" ".join(map(coder.decimal.__getitem__, ids))).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.array(counts, dtype=np.int64)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[*names, *made])
        coder.forget()

    return in_batches(rest, run, with_columns(kept, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as counts and hashes."""
    return round_trip_digests(documents(spark, sf_dir).select("doc_id", "text"))
