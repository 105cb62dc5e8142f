"""Substring deduplication: paragraphs that repeat across documents, by MinHash bands and exact similarity."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.near_join import shared_buckets, similarity_classes
from sievework.llm.session import Batches, broadcast_if_small, cut, documents, drop_paths, in_batches, set_aside, with_columns
from sievework.llm.wordscan import SPACED, Scan, mix, scan, shingles, text_slices

#: Words of a shingle, and the multiset Jaccard similarity of equal paragraphs in tenths.
WORDS, TENTHS = 5, 8
#: A sentence of so many words ends a paragraph; shorter ones are joined to what follows.
SENTENCE_WORDS = 8
#: Repeated paragraphs that follow one another go if they have so many words together; less is a common phrase (an argument of the operator).
RUN_WORDS = 20
#: BANDS bands of ROWS: at similarity 0.8 a pair escapes all with probability 0.002, at 0.9 with 0.00005.
BANDS, ROWS = 6, 2
#: Paragraphs with fewer shingles are similar by 0.8 only if they are equal, so they need no bands: n shingles are at most n / (n + 1) like others.
BANDED = TENTHS // (10 - TENTHS)

#: Words of a window that an earlier document must not have, however its sentences lie.
WINDOW = 50
#: Words of an anchor: of the anchors of a window the least hash is looked for in other documents.
ANCHOR = 16

#: Bytes of text handled at once.
SLICE = 1_000_000

_U = np.uint64


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[Scan, Scan, np.ndarray]:
    """Words by text, words by paragraph, and the text of each paragraph.

    A paragraph ends at a line's end and after a sentence of ``SENTENCE_WORDS`` words or more, so
    where it ends depends on nothing but the words near by: a passage put into another document falls into
    the same paragraphs there but for its first and last.
    """
    s = scan(data, offsets, SPACED)
    n = len(s.start)
    if not n:
        return s, Scan(s.data, offsets, s.start, s.end, s.doc, 0), np.zeros(0, dtype=np.int64)
    last = np.ones(n, dtype=bool)
    last[:-1] = s.doc[1:] != s.doc[:-1]
    lines = np.append(np.flatnonzero(data == 10), len(data) + 1)
    nxt = np.append(s.start[1:], len(data) + 1)
    last |= lines[np.searchsorted(lines, s.end)] < nxt
    closing = np.isin(data[s.end - 1], np.frombuffer(b".!?", dtype=np.uint8)) | last
    at = np.flatnonzero(closing)
    long_enough = np.diff(at, prepend=-1) >= SENTENCE_WORDS
    last[at[long_enough]] = True
    of = np.zeros(n, dtype=np.int64)
    np.cumsum(last[:-1], out=of[1:])
    return s, Scan(s.data, offsets, s.start, s.end, of, int(of[-1]) + 1), s.doc[np.flatnonzero(last)]


def _bags(p: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each paragraph's multiset of shingles, by paragraph; the n-th copy of a shingle is an element of its own."""
    h, of = shingles(p.hashes(), p, WORDS)
    with np.errstate(over="ignore"):
        own = mix(h + mix(of.astype(_U) + _U(1)))
        order = np.argsort(own, kind="stable")
        new = np.ones(len(own), dtype=bool)
        new[1:] = own[order][1:] != own[order][:-1]
        if not new.all():
            starts = np.flatnonzero(new)
            nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
            later = nth > 0
            h = h.copy()
            h[order[later]] = mix(h[order[later]] + nth[later].astype(_U) * _U(0xD6E8FEB86659FD93))
    return h, of


def _keys(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """A key of each paragraph's multiset."""
    sums = np.zeros(n, dtype=_U)
    if n:
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), np.searchsorted(of, np.arange(n)))
    return mix(sums).view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _units(batches: Batches) -> Batches:
    """The paragraph keys of each text."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column("text"), SLICE):
            _, p, doc = paragraphs(data, offsets)
            keys = _keys(*_bags(p), p.n_docs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), _lists(keys, np.bincount(doc, minlength=n))], names=["doc_id", "nodes"])


def _band_keys(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A row of band keys for each paragraph that occurs in ``of``, in ascending order."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    out = np.empty((len(starts), BANDS), dtype=_U)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, dtype=_U)
        for row in range(ROWS):
            salt = _U((band * ROWS + row + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            with np.errstate(over="ignore"):
                key = mix(key * _U(0x2545F4914F6CDD1D) + np.minimum.reduceat(mix(h + salt), starts))
        out[:, band] = key
    return out.view(np.int64)


def _buckets(batches: Batches) -> Batches:
    """(bucket, node) of each band of each paragraph that needs bands."""
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
            _, p, _ = paragraphs(data, offsets)
            h, of = _bags(p)
            keys = _keys(h, of, p.n_docs)
            # copies inside the slice give the same rows
            pick = np.zeros(p.n_docs, dtype=bool)
            pick[np.unique(keys, return_index=True)[1]] = True
            pick &= np.bincount(of, minlength=p.n_docs) >= BANDED
            if pick.any():
                found = _band_keys(h[pick[of]], of[pick[of]])
                yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(np.repeat(keys[pick], BANDS))], names=["bucket", "node"])


def _elements(batches: Batches) -> Batches:
    for batch in batches:
        for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
            _, p, _ = paragraphs(data, offsets)
            if p.n_docs:
                h, of = _bags(p)
                found = [pa.array(_keys(h, of, p.n_docs)), _lists(h.view(np.int64), np.bincount(of, minlength=p.n_docs)), _lists(_band_keys(h, of).reshape(-1), np.full(p.n_docs, BANDS))]
                yield pa.RecordBatch.from_arrays(found, names=["node", "elements", "buckets"])


def _both(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of runs of words from those of the run at each place and of the run ``step`` later."""
    with np.errstate(over="ignore"):
        return mix(h[: len(h) - step] * _U(0x2545F4914F6CDD1D) + h[step:] + _U(step))


def windows(s: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of WINDOW words of a text: its hash, the least hash of its anchors, and its first word.

    Two equal windows have the same least anchor, so windows are to be compared only where that one is shared.
    """
    n = len(s.start) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h, size = s.hashes(), 1
    while 2 * size <= ANCHOR:
        h, size = _both(h, size), 2 * size
    h = h if size == ANCHOR else _both(h, ANCHOR - size)
    least, many, run, size = h, 1, h, ANCHOR
    while 2 * many <= WINDOW - ANCHOR + 1:
        least, many = np.minimum(least[:-many], least[many:]), 2 * many
    if many < (of := WINDOW - ANCHOR + 1):
        least = np.minimum(least[: many - of], least[of - many :])
    while 2 * size <= WINDOW:
        run, size = _both(run, size), 2 * size
    run = run if size == WINDOW else _both(run, WINDOW - size)
    at = np.flatnonzero(s.doc[:n] == s.doc[WINDOW - 1 :])
    return run[at].view(np.int64), least[at].view(np.int64), at


def _by_doc(doc: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of ``n`` texts of its values, without repeats that follow one another; ``doc`` ascends."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return _lists(values[new], np.bincount(doc[new], minlength=n))


def _anchors(batches: Batches) -> Batches:
    """The least anchors of the windows of each text."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column("text"), SLICE):
            s = scan(data, offsets, SPACED)
            _, least, at = windows(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), _by_doc(s.doc[at], least, n)], names=["doc_id", "anchors"])


def _among(doc: np.ndarray, values: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its text."""
    size = np.diff(lists.offsets.to_numpy())
    flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
    if not len(flat) or not len(values):
        return np.zeros(len(values), dtype=bool)
    with np.errstate(over="ignore"):
        pair = lambda d, k: mix(k.view(_U) + mix(d.astype(_U) + _U(1)))
        return np.isin(pair(doc, values), pair(np.repeat(np.arange(len(size)), size), flat))


def _shared_windows(batches: Batches) -> Batches:
    """The windows of each text whose least anchor is in ``anchors``."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column("text"), SLICE):
            s = scan(data, offsets, SPACED)
            run, least, at = windows(s)
            pick = _among(s.doc[at], least, batch.column("anchors").slice(i, n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), _by_doc(s.doc[at[pick]], run[pick], n)], names=["doc_id", "windows"])


def _cleaned(batches: Batches, run_words: int) -> Batches:
    """Texts without the words of repeated windows and without the runs of repeated words that are long enough."""
    found = ("repeated", "windows")
    for batch in batches:
        texts = batch.column("text")
        for i, n, data, offsets in text_slices(texts, SLICE):
            s, p, doc = paragraphs(data, offsets)
            keys = _keys(*_bags(p), p.n_docs)
            unit = _among(doc, keys, batch.column("repeated").slice(i, n))
            n_hit = np.bincount(doc[unit], minlength=n)
            hit = unit[p.doc]
            if len(batch.column("windows").slice(i, n).flatten()):
                run, _, at = windows(s)
                at = at[_among(s.doc[at], run, batch.column("windows").slice(i, n))]
                depth = np.zeros(len(hit) + 1, dtype=np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + WINDOW, -1)
                hit |= np.cumsum(depth[:-1]) > 0
            if hit.any():
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (hit[1:] != hit[:-1]) | (s.doc[1:] != s.doc[:-1])
                run = np.cumsum(new) - 1
                hit &= np.bincount(run)[run] >= run_words
            removed = np.bincount(s.doc[hit], minlength=n)
            out = texts.slice(i, n)
            if hit.any():
                out = _without(data, offsets, s, hit, out)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(i, n) for c in batch.schema.names if c not in ("text", *found)),
                    pa.array(np.bincount(doc, minlength=n)), pa.array(n_hit), pa.array(np.bincount(s.doc, minlength=n)), pa.array(removed), out,
                ],
                names=[*(c for c in batch.schema.names if c not in ("text", *found)), "n_paragraphs", "n_repeated", "n_words", "n_removed", "text"],
            )


def _without(data: np.ndarray, offsets: np.ndarray, s: Scan, hit: np.ndarray, texts: pa.Array) -> pa.Array:
    """``texts`` with the words that are ``hit`` cut out, up to the next word that stays."""
    new = hit.copy()
    new[1:] &= ~hit[:-1] | (s.doc[1:] != s.doc[:-1])
    last = hit.copy()
    last[:-1] &= ~hit[1:] | (s.doc[1:] != s.doc[:-1])
    docs, begin = s.doc[new], s.start[new]
    end = np.minimum(np.append(s.start[1:], len(data))[last], offsets[1:][docs])
    out = texts.to_pylist()
    for d in np.unique(docs):
        at, parts = int(offsets[d]), []
        for u in range(np.searchsorted(docs, d), np.searchsorted(docs, d, side="right")):
            parts.append(data[at : begin[u]].tobytes())
            at = int(end[u])
        parts.append(data[at : offsets[d + 1]].tobytes())
        out[d] = b"".join(parts).decode("utf-8", "replace").rstrip(" \t")
    return pa.array(out, pa.string())


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, windows): for each document the hashes of its windows of WINDOW words that a document of lesser id has too."""
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    listed = cut(in_batches(texts, _anchors, "doc_id long, anchors array<long>"), "anchors")
    anchors = listed.select("doc_id", F.explode("anchors").alias("anchor"))
    several = lambda found, key: found.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = cut(several(anchors, "anchor").select("anchor"), "shared_anchors")
    lists = cut(anchors.join(broadcast_if_small(shared), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "anchor_lists")
    met = cut(in_batches(texts.join(lists, "doc_id"), _shared_windows, "doc_id long, windows array<long>"), "windows")
    drop_paths(docs.sparkSession, listed, shared, lists)
    rows = met.select("doc_id", F.explode("windows").alias("window"))
    firsts = cut(several(rows, "window").select("window", "first"), "first_windows")
    return rows.join(broadcast_if_small(firsts), "window").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("windows"))


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated): for each document the keys of its paragraphs that a document of lesser id has too."""
    spark = docs.sparkSession
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    listed = cut(in_batches(texts, _units, "doc_id long, nodes array<long>"), "paragraphs")
    units = listed.select("doc_id", F.explode("nodes").alias("node"))
    copies = cut(units.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("node", "first"), "copies")

    entries = in_batches(texts.select("text"), _buckets, "bucket long, node long")
    buckets = cut(shared_buckets(entries), "buckets")
    shared = cut(entries.join(broadcast_if_small(buckets), "bucket").distinct(), "entries")

    def details_of(nodes: DataFrame) -> DataFrame:
        nodes = broadcast_if_small(cut(nodes, "nodes"))
        ids = cut(units.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
        found = in_batches(texts.join(broadcast_if_small(ids), "doc_id", "left_semi").select("text"), _elements, "node long, elements array<long>, buckets array<long>")
        return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    near = similarity_classes(shared, details_of, TENTHS)
    # the first document of a class: of copies it is known, of others it is looked up
    firsts = units.join(broadcast_if_small(near), "node").groupBy("label").agg(F.min("doc_id").alias("first"))
    known = cut(near.join(firsts, "label").select("node", "first"), "known")
    every = cut(copies.join(known, "node", "left_anti").union(known), "every")
    drop_paths(spark, copies, buckets, shared, near, known)
    return units.join(broadcast_if_small(every), "node").where("first < doc_id").groupBy("doc_id").agg(F.collect_set("node").alias("repeated"))


def remove_repeated_paragraphs(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without passages that an earlier document has, and n_paragraphs, n_repeated, n_words, n_removed.

    Earlier is: of lesser doc_id. Paragraphs are lines cut after sentences of eight words or more; two are equal if
    the multiset Jaccard similarity of their five-word shingles is 0.8 or more, in one component of such links. Beside
    them, every window of 50 words that an earlier document has word by word is repeated, wherever it begins. A run
    of repeated words, from paragraphs and windows together, is removed if it has ``run_words`` words or more, so that common phrases
    stay; n_removed counts words.

    Nulls: a null text has no paragraph and stays null; a document with a null doc_id stays as it is. Repeated rows of
    one doc_id are the same document, so they do not repeat each other; all keep their first passages. Texts
    without words are unchanged. Further columns are kept; those named like the counts, ``repeated`` or ``windows`` are replaced. An
    empty table gives an empty table.
    """
    made = ["n_paragraphs", "n_repeated", "n_words", "n_removed"]
    docs = docs.drop("repeated", "windows", *made)
    found = repeated_paragraphs(docs).join(repeated_windows(docs), "doc_id", "full")
    rest = [f"`{c.replace('`', '``')}`" for c in docs.columns if c != "text"]
    none = F.array().cast("array<bigint>")
    joined = docs.join(found, "doc_id", "left").select(*rest, "text", F.coalesce("repeated", none).alias("repeated"), F.coalesce("windows", none).alias("windows"))
    schema = with_columns(docs.drop("text"), f"{', '.join(f'{c} long' for c in made)}, text string")
    return in_batches(joined, partial(_cleaned, run_words=run_words), schema).select(*(f"`{c.replace('`', '``')}`" for c in docs.columns), *made)


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    out = remove_repeated_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_paragraphs", "n_repeated", "n_words", "n_removed", (F.col("n_removed") > 0).alias("removed"), "text")


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned texts, without documents of which nothing is left.

    A null text, a text without words and a document with a null doc_id stay as they are; rows that repeat a doc_id are one document. Columns stay, whatever their
    names. An empty table gives an empty table.
    """
    own = set_aside(docs, ["n_paragraphs", "n_repeated", "n_words", "n_removed", "repeated", "windows"])
    out = remove_repeated_paragraphs(docs.withColumnsRenamed(own)).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.select(*(F.col(f"`{own.get(c, c).replace('`', '``')}`").alias(c) for c in docs.columns))
