"""MinHash near-duplicate detection with BagMinHash signatures of weighted shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.near_join import shared_buckets, similarity_classes
from sievework.llm.session import Batches, broadcast_if_small, cut, documents, drop_paths, in_batches
from sievework.llm.wordscan import SPACED, mix, scan, shingles, text_slices

#: Words of a shingle.
WORDS = 5
#: Multiset Jaccard similarity of near duplicates, in tenths.
TENTHS = 8
#: Signature registers: BANDS bands of ROWS. At similarity 0.8 a pair escapes all bands with probability 0.0007.
BANDS, ROWS = 24, 6
#: Registers in which a candidate pair agrees: at similarity 0.8 fewer agree with probability 0.0001.
AGREE = 97

_U = np.uint64
_TO_UNIT = 2.0**-53


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1] that depend on seed and salt alone."""
    with np.errstate(over="ignore"):
        return ((mix(seed + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> _U(11)).astype(np.float64) + 1.0) * _TO_UNIT


def bag_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """BagMinHash signatures, one row of ``registers`` floats for each text; texts without elements have inf.

    The weight axis is cut into levels (0, 1], (1, 2], (2, 4], (4, 8]... Each element has an
    independent Poisson process on each level, with a rate as large as the level is long. A point
    falls to a random register at a random height; it counts if the height is below the element's
    weight, so a level wholly below the weight counts in full and the last one is thinned. A
    register keeps its first point. A process is followed only until its points come later than
    the latest register of its text. Two texts agree in a register with the probability of their
    weighted Jaccard similarity.
    """
    sig = np.full(n_docs * registers, np.inf)
    if not len(elements):
        return sig.reshape(n_docs, registers)
    ids, owner, low, high, top = [elements], [doc], [np.zeros(len(elements))], [np.ones(len(elements))], [weights.astype(np.float64)]
    live, floor = np.flatnonzero(weights > 1), 1.0
    while len(live):
        ids.append(elements[live])
        owner.append(doc[live])
        low.append(np.full(len(live), floor))
        high.append(np.full(len(live), 2 * floor))
        top.append(weights[live].astype(np.float64))
        floor *= 2
        live = live[weights[live] > floor]
    ids, owner, low, high, top = (np.concatenate(x) for x in (ids, owner, low, high, top))
    with np.errstate(over="ignore"):
        seed = mix(ids + high.astype(_U) * _U(0xD6E8FEB86659FD93))
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        time = time - np.log(_uniform(seed, 3 * step)) / (high - low)
        with np.errstate(over="ignore"):
            register = (mix(seed + _U((3 * step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % _U(registers)).astype(np.int64)
        counts = top >= high
        if not counts.all():
            part = np.flatnonzero(~counts)
            counts[part] = low[part] + _uniform(seed[part], 3 * step + 2) * (high[part] - low[part]) <= top[part]
        np.minimum.at(sig, owner[counts] * registers + register[counts], time[counts])
        latest = sig.reshape(n_docs, registers).max(axis=1)
        on = time < latest[owner]
        seed, time, owner, low, high, top = (x[on] for x in (seed, time, owner, low, high, top))
        step += 1
    return sig.reshape(n_docs, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = sig.view(_U).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key * _U(0x2545F4914F6CDD1D) + bits[:, :, j])
    return key


def _bags(data: np.ndarray, offsets: np.ndarray):
    """(element, weight, text) of distinct shingles of each text, and the texts' number."""
    s = scan(data, offsets, SPACED)
    h, doc = shingles(s.hashes(), s, WORDS)
    with np.errstate(over="ignore"):
        own = mix(h + mix(doc.astype(_U) + _U(1)))
    order = np.argsort(own, kind="stable")
    first = np.ones(len(own), dtype=bool)
    first[1:] = own[order][1:] != own[order][:-1]
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(own)))
    pick = order[at]
    by_doc = np.argsort(doc[pick], kind="stable")
    return h[pick][by_doc], weight[by_doc], doc[pick][by_doc], s.n_docs


def _list(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _content(e: np.ndarray, w: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A key of each text's multiset: a sum over it, so that order plays no part."""
    key = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        np.add.at(key, doc, mix(e ^ _U(0xA5A5A5A5A5A5A5A5)) * w.astype(_U))
    return mix(key).view(np.int64)


def _signatures(batches: Batches) -> Batches:
    """Content key and band keys of each text."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column("text")):
            e, w, doc, _ = _bags(data, offsets)
            size = np.bincount(doc, weights=w, minlength=n).astype(np.int64)
            sig = bag_minhash(e, w, doc, n, BANDS * ROWS)
            keys = band_keys(sig, BANDS, ROWS)
            ids = batch.column("doc_id").slice(i, n)
            has = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            sketch = mix(sig[has].view(_U)).reshape(-1).astype(np.uint16).view(np.int16)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(_content(e, w, doc, n), mask=~has),
                    _list(keys[has].reshape(-1).view(np.int64), np.where(has, BANDS, 0)),
                    _list(sketch, np.where(has, BANDS * ROWS, 0)),
                ],
                names=["doc_id", "node", "bands", "sketch"],
            )


def _elements(batches: Batches) -> Batches:
    """Each text's multiset as a set: its n-th copy of a shingle is an element of its own."""
    for batch in batches:
        for i, n, data, offsets in text_slices(batch.column("text")):
            e, w, doc, _ = _bags(data, offsets)
            node = _content(e, w, doc, n)
            at = np.repeat(np.cumsum(w) - w, w)
            nth = np.arange(len(at)) - at
            e, doc = np.repeat(e, w), np.repeat(doc, w)
            with np.errstate(over="ignore"):
                e = np.where(nth > 0, mix(e + nth.astype(_U) * _U(0xD6E8FEB86659FD93)), e)
            yield pa.RecordBatch.from_arrays([pa.array(node), _list(e.view(np.int64), np.bincount(doc, minlength=n))], names=["node", "elements"])


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, class_id, class_size, keep): each document with the least doc_id of its class.

    Two texts are linked if the multiset Jaccard similarity of their five-word shingles (words
    between ASCII white space, A-Z in lower case) is 0.8 or more; classes are connected components.
    Texts with equal multisets are one node from the start, so copies are never paired. Candidates share
    a band of the signature and agree in two thirds of all registers; candidates are verified on the multisets themselves
    (see near_join: no bucket is cut off).

    Nulls: a null text, a text without words and a null doc_id are alone in their class; class_id is
    the doc_id. A text under five words is one shingle. Repeated rows: rows of equal text are one class, whatever their ids; ``keep`` is
    true for the rows with the least doc_id, so rows that repeat that id too. Columns but doc_id and text
    are not read. An empty table gives an empty table.
    """
    texts = docs.select("doc_id", "text")
    signed = cut(in_batches(texts, _signatures, "doc_id long, node long, bands array<long>, sketch array<smallint>"), "signatures")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    entries = signed.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket")).distinct()
    shared = cut(entries.join(shared_buckets(entries), "bucket"), "entries")

    def holders(of: DataFrame) -> DataFrame:
        """(node, doc_id): the document that stands for each node."""
        return signed.select("node", "doc_id").join(broadcast_if_small(of), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def details_of(of: DataFrame) -> DataFrame:
        held = cut(holders(cut(of, "nodes")), "holders")
        ids = cut(held.select("doc_id").distinct(), "ids")
        found = in_batches(texts.join(broadcast_if_small(ids), "doc_id", "left_semi").select("text"), _elements, "node long, elements array<long>")
        # where an id has several texts, some may be of nodes that nobody asked for
        own = signed.join(broadcast_if_small(held), ["node", "doc_id"], "left_semi").select("node", "sketch", F.col("bands").alias("buckets")).dropDuplicates(["node"])
        return found.where(F.size("elements") > 0).dropDuplicates(["node"]).join(own, "node")

    classes = similarity_classes(shared, details_of, TENTHS, AGREE)
    drop_paths(docs.sparkSession, shared)
    named = nodes.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    named = cut(named.join(sizes, "label").select("node", "class_id", "class_size"), "classes")
    out = signed.select("doc_id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    return out.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return near_duplicate_classes(documents(spark, sf_dir))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one of least doc_id.

    Rows that repeat that doc_id are taken as that document and stay; a null doc_id stays.
    """
    gone = near_duplicate_classes(docs).where(~F.col("keep") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    gone = cut(gone, "gone")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
