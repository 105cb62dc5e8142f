"""Language identification by the nearest of several TF-IDF centroids of each language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.session import Batches, broadcast_if_small, cut, documents, in_batches, row_slices, set_aside, with_columns
from sievework.llm.wordscan import mix, text_slices

#: Texts of each language that the classifier is fitted on, about: a bounded sample of whole texts, chosen by a hash of doc_id and text.
SAMPLE_PER_LANGUAGE = 800
#: Texts of all languages together, about: with many languages each has fewer, so the sample does not grow with their number.
SAMPLE_TOTAL = 4000
#: A text of more bytes is chosen the more rarely the longer it is, so a sampled text has so many on average at most.
SAMPLE_BYTES = 20_000
#: Buckets of hashed n-grams, and the n-grams' lengths in bytes.
BUCKETS, NGRAMS = 32_768, (1, 2, 3, 4)
#: Centroids of each language, and rounds of spherical k-means.
CENTROIDS, ROUNDS = 4, 8
#: Length classes of texts by the power of two of their bytes, the least and the greatest.
SHORTEST, LONGEST = 4, 14
#: A text is rejected if it is farther from its centroid than this quantile of its language's sample texts, cut to the least
#: length of its class, and than MARGIN of the way from there to distance 1. A class with fewer than ENOUGH sample texts has the reach of the shorter one.
QUANTILE, MARGIN, ENOUGH = 0.995, 0.25, 50
#: Texts whose n-grams are counted at once: each takes a count for every bucket meanwhile.
TEXTS = 16

_U = np.uint64
_LETTER = regex.compile(r"\p{L}")
#: A-Z to lower case; digits, punctuation and control characters to a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[[b for b in range(128) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20


@dataclass
class Centroids:
    """Unit centroids by row, the language and greatest accepted distances by length class of each, and inverse document frequencies."""

    rows: np.ndarray
    langs: list[str]
    reach: np.ndarray
    idf: np.ndarray


@dataclass
class Rows:
    """Sparse rows: the bucket and value of each entry by row, and the row's first entry."""

    first: np.ndarray
    bucket: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def times(self, dense: np.ndarray) -> np.ndarray:
        """Products with the rows of ``dense``, a row for each of these rows."""
        out = np.zeros((len(self), len(dense)), dtype=np.float32)
        turned = np.ascontiguousarray(dense.T)
        for i in range(0, len(self), TEXTS):
            f = self.first[i : i + TEXTS + 1]
            live = np.flatnonzero(np.diff(f))
            if len(live):
                products = turned[self.bucket[f[0] : f[-1]]] * self.value[f[0] : f[-1], None]
                out[i + live] = np.add.reduceat(products, f[live] - f[0], axis=0)
        return out


def stacked(parts: list[Rows]) -> Rows:
    sizes = [np.diff(p.first) for p in parts]
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if parts else np.zeros(1, dtype=np.int64)
    none = np.zeros(0, dtype=np.int32)
    return Rows(first, np.concatenate([none, *(p.bucket for p in parts)]), np.concatenate([none.astype(np.float32), *(p.value for p in parts)]))


def _counts(data: np.ndarray, offsets: np.ndarray) -> Rows:
    n = len(offsets) - 1
    folded = _FOLD[data].astype(_U)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    code = np.zeros(len(data), dtype=_U)
    found = [np.zeros(0, dtype=np.int64)]
    for k in range(1, max(NGRAMS) + 1):
        m = len(data) - k + 1
        if m <= 0:
            break
        code = code[:m] * _U(257) + folded[k - 1 :]
        if k not in NGRAMS:
            continue
        inside = (doc[:m] == doc[k - 1 :]) & ((folded[:m] != 0x20) | (folded[k - 1 :] != 0x20))
        found.append((mix(code[inside] + _U(k << 40)) % _U(BUCKETS)).astype(np.int64) + doc[:m][inside] * BUCKETS)
    dense = np.bincount(np.concatenate(found), minlength=n * BUCKETS)
    at = np.flatnonzero(dense)
    return Rows(np.searchsorted(at, np.arange(n + 1) * BUCKETS), (at % BUCKETS).astype(np.int32), dense[at].astype(np.float32))


def term_counts(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Hashed n-gram counts, a row for each text; n-grams of spaces only do not count."""
    n = len(offsets) - 1
    return stacked([_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i in range(0, n, TEXTS) for j in [min(n, i + TEXTS)]])


def vectors(counts: Rows, idf: np.ndarray) -> Rows:
    """Unit vectors of (1 + log tf) * idf; no entry for a text without n-grams."""
    v = (1 + np.log(counts.value)) * idf[counts.bucket]
    of = counts.of()
    norm = np.sqrt(np.bincount(of, weights=v.astype(np.float64) ** 2, minlength=len(counts)))
    return Rows(counts.first, counts.bucket, (v / norm[of]).astype(np.float32))


def length_class(sizes: np.ndarray) -> np.ndarray:
    """The length class of texts of so many bytes, from 0."""
    return np.clip(np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64), SHORTEST, LONGEST) - SHORTEST


def _counted(texts: list[bytes]) -> Rows:
    return stacked([term_counts(data, offsets) for _, _, data, offsets in text_slices(pa.array(texts, pa.binary()), 500_000)])


def _reach(texts: list[bytes], centres: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The greatest accepted distance of each length class."""
    out = np.ones(LONGEST - SHORTEST + 1)
    for c in range(len(out)):
        size = 1 << c + SHORTEST
        of_class = [t[:size].decode("utf-8", "ignore").encode() for t in texts if len(t) >= size]
        if len(of_class) >= ENOUGH or not c and of_class:
            far = float(np.quantile(1 - vectors(_counted(of_class), idf).times(centres).max(axis=1), QUANTILE))
            out[c] = far + MARGIN * (1 - far)
        elif c:
            out[c] = out[c - 1]
    return out


def fit(samples: dict[str, list[bytes]]) -> Centroids:
    """Centroids by spherical k-means within each language."""
    langs = sorted(samples)
    counts = {lang: _counted(samples[lang]) for lang in langs}
    seen, total = sum((np.bincount(c.bucket, minlength=BUCKETS) for c in counts.values()), np.zeros(BUCKETS)), sum(map(len, counts.values()))
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    rows, names, reach = [], [], []
    for lang in langs:
        v = vectors(counts[lang], idf)
        full = np.flatnonzero(np.diff(v.first))
        if not len(full):
            continue
        v = Rows(np.append(v.first[full], len(v.bucket)), v.bucket, v.value)
        of = v.of()

        def dense(i: int, v: Rows = v) -> np.ndarray:
            out = np.zeros(BUCKETS, dtype=np.float32)
            out[v.bucket[v.first[i] : v.first[i + 1]]] = v.value[v.first[i] : v.first[i + 1]]
            return out

        k = min(CENTROIDS, len(v))
        centres = dense(0)[None]
        while len(centres) < k:  # the farthest text from those chosen comes next
            centres = np.concatenate([centres, dense(int(np.argmin(v.times(centres).max(axis=1))))[None]])
        for _ in range(ROUNDS):
            near = v.times(centres).argmax(axis=1)
            own = near[of]
            sums = np.stack([np.bincount(v.bucket[own == j], weights=v.value[own == j], minlength=BUCKETS) if (near == j).any() else centres[j] for j in range(k)])
            centres = (sums / np.linalg.norm(sums, axis=1, keepdims=True)).astype(np.float32)
        near = v.times(centres).argmax(axis=1)
        kept = [j for j in range(k) if (near == j).any()]
        rows += [centres[j] for j in kept]
        names += [lang] * len(kept)
        reach += [_reach(samples[lang], centres[kept], idf)] * len(kept)
    return Centroids(np.array(rows, dtype=np.float32).reshape(len(rows), BUCKETS), names, np.array(reach), idf)


def sample_texts(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[bytes]]:
    """About ``per_language`` texts of each language (SAMPLE_TOTAL of all), those of least hash; of (doc_id, text, lang) without nulls in text and lang."""
    top = 1_000_000_007
    hashed = labelled.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.abs(F.xxhash64("doc_id", "text") % top))
    sizes = cut(hashed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    many = sizes.count()
    if not many:
        return {}
    each = min(float(per_language), SAMPLE_TOTAL / many)
    share = F.lit(each) / F.col("n") * F.least(F.lit(1.0), F.lit(float(SAMPLE_BYTES)) / F.greatest(F.octet_length("text"), F.lit(1)))
    picked = hashed.join(broadcast_if_small(sizes), "lang").where(F.col("h") < share * top).select("lang", "h", "text")
    out: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "h", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


_MADE = ["lang_pred", "score", "rejected"]


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """``docs`` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected, from ``text`` alone.

    A null text, and one without a letter, has ``und``, score 0 and is rejected. Any other text has the language
    of the nearest centroid; it is rejected if it is farther from it than nearly all sample texts of that language, cut to the
    length of its class, are from their own, by some margin. A text of letters whose n-grams are all unknown has score 0. Whole texts are read, whatever their length;
    repeated rows are judged each. Columns of those names are replaced, others stay. An empty table gives an
    empty table; a model of no centroid rejects all as ``und``.
    """
    docs = docs.drop(*_MADE)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        m = shipped.value
        names = np.array([*m.langs, "und"], dtype=object)
        for rows, data, offsets in row_slices(batches, 600_000):
            n = rows.num_rows
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in rows.column("text").to_pylist()])
            best, score = np.full(n, -1), np.zeros(n)
            far = np.ones(n, dtype=bool)
            if len(m.langs):
                close = vectors(term_counts(data, offsets), m.idf).times(m.rows)
                best, score = close.argmax(axis=1), close.max(axis=1)
                far = 1 - score > m.reach[best, length_class(np.diff(offsets))]
            best[~letters], score[~letters], far[~letters] = -1, 0.0, True
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64)), pa.array(far)],
                names=[*rows.schema.names, *_MADE],
            )

    return in_batches(docs, run, with_columns(docs, "lang_pred string, score double, rejected boolean"))


def held_out() -> Column:
    """Whether a document is held out: crc32 of its doc_id as text leaves no remainder by 5; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def fit_on(docs: DataFrame) -> Centroids:
    """The classifier of the documents that are not held out."""
    labelled = docs.where(~F.coalesce(held_out(), F.lit(False))).select("doc_id", "text", "lang")
    return fit(sample_texts(labelled))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), fit_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose language is rejected, by a classifier fitted on those not held out.

    A null text, and one without a letter, is rejected; so are all texts where no row has a text and a lang. A null doc_id is not held out; repeated rows are judged
    each. Columns stay, those named like the ones of :func:`identify` too. An empty table gives an empty table.
    """
    own = set_aside(docs, _MADE)
    found = identify(docs.withColumnsRenamed(own), fit_on(docs)).where(~F.col("rejected"))
    return found.select(*(F.col(f"`{own.get(c, c).replace('`', '``')}`").alias(c) for c in docs.columns))
