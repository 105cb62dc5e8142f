"""Scoring of texts by a log-bilinear neural language model, trained by noise-contrastive estimation.

A token's log-probability is that of its class after the two tokens before it, and that of the word within its class. Words that have a share of the
training tokens of their own (see Vocabulary) are the vocabulary, which grows with the corpus. The most frequent ones are classes by themselves, the
others are dealt to classes of equal mass in order of frequency; all that is not in the vocabulary falls into classes by length and last character.

Every word of the vocabulary has two vectors, one as a context and one as a target, fitted by noise-contrastive estimation; so have the classes.
Scores are normalised over all classes, and over all words of a class, by matrix products, so the probabilities of all words sum to one.

All training tokens take part, as counts that tasks make and Spark adds up: of words, of triples of classes, and of each vocabulary word with the class
before it and the class behind it. Noise-contrastive estimation compares a target's score with its noise alone, so once the classes'
vectors are known each word's vectors depend on that word's counts only, and are fitted where these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.session import Batches, cut, documents, drop_paths, in_batches
from sievework.llm.wordscan import SPACED, Scan, distinct, scan, text_slices

#: Classes: 0 the end (and what stands before a text), TOP frequent words, BINS classes of other vocabulary words, SHAPES of words outside it.
TOP, BINS, SHAPES = 47, 32, 16
CLASSES = 1 + TOP + BINS + SHAPES
#: A word is in the vocabulary from N ** (2 / 3) / SHARE of the N training tokens on, and from LEAST on; so there are SHARE * N ** (1 / 3) at most.
SHARE, LEAST = 400, 2
#: Size of the vectors, noise samples for each token, steps and rate of training for the classes, steps for words, and the pull of words' vectors to 0.
SIZE, NOISE, STEPS, RATE, NEWTON, PULL = 16, 8, 150, 0.05, 8, 4.0
#: Bytes of text whose words are grouped before they are shuffled, and tokens whose classes are scored at once.
GROUP_BYTES, CHUNK = 4_000_000, 16_384

_CLOSING = np.frombuffer(b".!?,;:", dtype=np.uint8)
#: The end as a key among words; no word has white space.
END = b"\n"


def shape_class(length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The class of words outside the vocabulary, by bytes and last byte."""
    return 1 + TOP + BINS + (np.minimum(length, 8) - 1) * 2 + np.isin(last, _CLOSING)


def _shape_column(word: str) -> Column:
    closing = F.hex(F.substring(word, -1, 1)).isin("2E", "21", "3F", "2C", "3B", "3A")
    return 1 + TOP + BINS + (F.least(F.octet_length(word), F.lit(8)) - 1) * 2 + closing.cast("int")


@dataclass
class ClassModel:
    """Class vectors: as context ``r`` (with the scales ``last`` and ``before`` of the two places), as target ``q`` with ``bias``, and the noise."""

    r: np.ndarray
    q: np.ndarray
    last: np.ndarray
    before: np.ndarray
    bias: np.ndarray
    noise: np.ndarray

    def scores(self) -> np.ndarray:
        """Scores of all classes by (before last, last): a row for each context."""
        c = len(self.r)
        h = (self.r * self.before)[:, None, :] + (self.r * self.last)[None, :, :]
        return h.reshape(c * c, -1) @ self.q.T + self.bias


def train_log_bilinear(triples: np.ndarray, seed: int = 7) -> ClassModel:
    """Class vectors from counts by (before last, last, next).

    Scores are q(context) . r(class) + b(class) with q the sum of the context's vectors, each scaled by
    its place. Training tells tokens from noise by their class frequencies, NOISE samples for each token; the noise
    term is taken in expectation over all classes, so nothing is drawn.
    """
    c = triples.shape[0]
    n = triples.reshape(c * c, c).astype(np.float64)
    total = max(n.sum(), 1.0)
    noise = (n.sum(axis=0) + 0.5) / (total + 0.5 * c)
    shift = np.log(NOISE * noise)
    n /= total
    per_context = n.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (c, SIZE)), rng.normal(0, 0.1, (c, SIZE)), np.ones(SIZE), np.ones(SIZE), np.log(noise)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    used = np.flatnonzero(per_context[:, 0])
    nu, pu, u1, v1 = n[used], per_context[used], used // c, used % c
    for step in range(1, STEPS + 1):
        r, q, a, b, bias = params
        h = r[u1] * a + r[v1] * b
        delta = h @ q.T + bias - shift
        real = 1 / (1 + np.exp(-delta))
        g = NOISE * pu * noise * real - nu * (1 - real)  # gradient of the loss by the scores
        gh = g @ q
        gr = np.zeros_like(r)
        np.add.at(gr, u1, gh * a)
        np.add.at(gr, v1, gh * b)
        for i, grad in enumerate((gr, g.T @ h, (gh * r[u1]).sum(axis=0), (gh * r[v1]).sum(axis=0), g.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad * grad
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-12)
    r, q, a, b, bias = params
    return ClassModel(r, q, b, a, bias, noise)


def fit_words(real: np.ndarray, noise: np.ndarray, start: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Vectors, one for each row, by noise-contrastive estimation: the row's scores are ``start`` + vector . feature, less the noise's log-rate.

    ``real`` and ``noise`` are the counts of tokens and the expected counts of noise by feature. Newton's method on all rows at once.
    """
    theta = np.zeros((len(real), features.shape[1]))
    outer = (features[:, :, None] * features[:, None, :]).reshape(len(features), -1)
    pull = PULL * np.eye(features.shape[1])
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(start + theta @ features.T, -30, 30)))
        gradient = (noise * p - real * (1 - p)) @ features + PULL * theta
        curve = (((real + noise) * p * (1 - p)) @ outer).reshape(len(real), *pull.shape) + pull
        step = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        theta -= step / np.maximum(1, np.abs(step).max(axis=1, keepdims=True) / 2)
    return theta


def log_sum(scores: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the last axis."""
    top = scores.max(axis=-1, keepdims=True)
    return (top + np.log(np.exp(scores - top).sum(axis=-1, keepdims=True)))[..., 0]


@dataclass
class Vocabulary:
    """The vocabulary's words by ascending hash, their counts and classes, and what is known of all words."""

    words: Scan
    order: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n_tokens: int
    n_words: int
    end_count: int

    @staticmethod
    def of(frequent: list[tuple[bytes, int]], n_tokens: int, n_words: int, end_count: int) -> Vocabulary:
        """From (word, count)."""
        ranked = sorted(frequent, key=lambda x: (-x[1], x[0]))
        joined = b" ".join(w for w, _ in ranked)
        words = scan(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]), SPACED)
        counts = np.array([n for _, n in ranked], dtype=np.int64)
        classes = np.arange(1, len(ranked) + 1)
        rest = counts[TOP:]
        if len(rest):
            mass = np.cumsum(rest) - rest / 2
            classes[TOP:] = 1 + TOP + np.minimum((mass * BINS / rest.sum()).astype(np.int64), BINS - 1)
        h = words.hashes()
        order = np.argsort(h)
        return Vocabulary(words, order, h[order], counts[order], classes[order], n_tokens, n_words, end_count)

    def places(self, s: Scan, hashes: np.ndarray) -> np.ndarray:
        """Where each word stands in the vocabulary, or -1; equal hashes are compared byte by byte."""
        out = np.full(len(hashes), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == hashes)
            out[met] = np.where(s.same(met, self.words, self.order[at[met]]), at[met], -1)
        return out


@dataclass
class Tokens:
    """Tokens of some texts (words and each text's end) in order: text, class, place in the vocabulary (-1: none)."""

    doc: np.ndarray
    cls: np.ndarray
    place: np.ndarray

    def before(self, values: np.ndarray, k: int, none: int) -> np.ndarray:
        """The value of the token ``k`` before each in its text, or ``none``."""
        out = np.full(len(values), none)
        out[k:] = np.where(self.doc[k:] == self.doc[:-k], values[:-k], none)
        return out


def tokens_of(s: Scan, place: np.ndarray, v: Vocabulary) -> Tokens:
    counts = s.counts()
    doc = np.repeat(np.arange(s.n_docs), counts + 1)
    is_word = np.ones(len(doc), dtype=bool)
    is_word[np.cumsum(counts + 1) - 1] = False
    cls, at = np.zeros(len(doc), dtype=np.int64), np.full(len(doc), -1)
    if len(place):
        own = v.classes[np.maximum(place, 0)] if len(v.classes) else place
        cls[is_word] = np.where(place >= 0, own, shape_class(s.end - s.start, s.data[s.end - 1]))
        at[is_word] = place
    return Tokens(doc, cls, at)


@dataclass
class Model:
    """All that scoring needs: class scores by context, the vectors of vocabulary words, and log-masses of the classes of other words (base 10)."""

    vocabulary: Vocabulary
    scores: np.ndarray  # (CLASSES ** 2, CLASSES), by context of two classes
    r: np.ndarray
    q: np.ndarray
    context: np.ndarray  # what a word adds, as the last one, to the vector of its class
    target: np.ndarray  # a word's vector within its class, and its bias last
    within: np.ndarray
    masses: np.ndarray  # (class, class before): log of the sum over the words of a class

    @staticmethod
    def of(vocabulary: Vocabulary, classes: ClassModel, context: np.ndarray, target: np.ndarray, within: np.ndarray) -> Model:
        masses = np.zeros((CLASSES, CLASSES))
        for c in range(1 + TOP, 1 + TOP + BINS):
            of = np.flatnonzero(vocabulary.classes == c)
            if len(of):
                masses[c] = log_sum(classes.r @ target[of, :-1].T + target[of, -1])
        f = np.float32
        return Model(vocabulary, classes.scores().astype(f), classes.r.astype(f), classes.q.astype(f), context.astype(f), target.astype(f), within, masses.astype(f))

    def class_logs(self, before: np.ndarray, last: np.ndarray, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class after two classes, the last being the vocabulary word ``place`` (-1: none)."""
        out = np.empty(len(cls))
        for i in range(0, len(cls), CHUNK):
            part = slice(i, i + CHUNK)
            s = self.scores[before[part] * CLASSES + last[part]]
            word = np.flatnonzero(place[part] >= 0)
            if len(word):
                one, which = np.unique(place[part][word], return_inverse=True)
                s[word] += (self.context[one] @ self.q.T)[which]
            out[part] = s[np.arange(len(s)), cls[part]] - log_sum(s)
        return out

    def word_logs(self, place: np.ndarray, cls: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Natural log-probability of each vocabulary word within its class after a class; 0 for words that are their class."""
        out = np.zeros(len(place))
        many = np.flatnonzero(cls > TOP)
        t, h = self.target[place[many]], self.r[last[many]]
        out[many] = np.einsum("ij,ij->i", t[:, :-1], h) + t[:, -1] - self.masses[cls[many], last[many]]
        return out

    def logs(self, t: Tokens) -> np.ndarray:
        """log10 of each token's probability; of a word outside the vocabulary but for its count, whose log10 is to be added."""
        last, before = t.before(t.cls, 1, 0), t.before(t.cls, 2, 0)
        out = self.class_logs(before, last, t.before(t.place, 1, -1), t.cls)
        known = np.flatnonzero(t.place >= 0)
        out[known] += self.word_logs(t.place[known], t.cls[known], last[known])
        out /= np.log(10)
        other = t.cls > TOP + BINS
        out[other] -= self.within[t.cls[other]]
        return out


def _groups(batches: Batches) -> Iterator[tuple[pa.RecordBatch, Scan]]:
    """Runs of rows with about GROUP_BYTES of text, or one row, and their words."""

    def runs() -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in runs():
        for i, n, data, offsets in text_slices(batch.column("text"), 2 * GROUP_BYTES):
            for j in range(0, n, 30_000):
                k = min(n, j + 30_000)
                yield batch.slice(i + j, k - j), scan(data[offsets[j] : offsets[k]], offsets[j : k + 1] - offsets[j], SPACED)


def _words(s: Scan, at: np.ndarray) -> pa.Array:
    whole = s.data.tobytes()
    return pa.array([whole[a:b] for a, b in zip(s.start[at].tolist(), s.end[at].tolist(), strict=True)], pa.binary())


def _count_words(batches: Batches) -> Batches:
    for rows, s in _groups(batches):
        at, which = distinct(s, s.hashes(), np.arange(len(s.start)))
        yield pa.RecordBatch.from_arrays([_words(s, at), pa.array(np.bincount(which, minlength=len(at)), pa.int64())], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([rows.num_rows], pa.int64())], names=["word", "c"])


def held_out_column() -> Column:
    """Whether crc32 of doc_id as text leaves 1 by 5; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


#: Kinds of counts: triples of classes, a vocabulary word by the class before it, and by the class behind it.
TRIPLE, TARGET, CONTEXT = 0, 1, 2


def _count_cells(training: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(kind, cell, n): TRIPLE cells number (before last, last, next), the others (place, class)."""
    known = training.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        triples = np.zeros(CLASSES**3, dtype=np.int64)

        def rows(kind: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), kind, dtype=np.int32)), pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["kind", "cell", "n"])

        for _, s in _groups(batches):
            v = known.value
            t = tokens_of(s, v.places(s, s.hashes()), v)
            last = t.before(t.cls, 1, 0)
            triples += np.bincount((t.before(t.cls, 2, 0) * CLASSES + last) * CLASSES + t.cls, minlength=CLASSES**3)
            # words that are classes by themselves have no vectors of their own
            for kind, place, cls in ((TARGET, np.where(t.cls > TOP, t.place, -1), last), (CONTEXT, np.where(last > TOP, t.before(t.place, 1, -1), -1), t.cls)):
                of = place >= 0
                yield rows(kind, *np.unique(place[of] * CLASSES + cls[of], return_counts=True))
        at = np.flatnonzero(triples)
        yield rows(TRIPLE, at, triples[at])

    return in_batches(training, run, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))


def _fit_vectors(cells: DataFrame, classes: ClassModel, pairs: np.ndarray, vocabulary: Vocabulary) -> DataFrame:
    """(kind, place, vector) of the vocabulary words; ``pairs`` counts tokens by (class before, class)."""
    total = np.bincount(vocabulary.classes, weights=vocabulary.counts, minlength=CLASSES)
    after = pairs / np.maximum(pairs.sum(axis=0, keepdims=True), 1)  # share of the classes before each class
    usual = (after.T @ classes.r) * classes.before  # what the class before last adds on average
    shared = cells.sparkSession.sparkContext.broadcast((classes, pairs, vocabulary.classes, vocabulary.counts, total, usual))

    def run(batches: Batches) -> Batches:
        m, pairs, of_class, counts, total, usual = shared.value
        with_bias = np.column_stack([m.r, np.ones(len(m.r))])
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rows = batch.slice(i, 2000)
                n, kind, place = rows.num_rows, rows.column("kind").to_numpy(), rows.column("place").to_numpy()
                lists = rows.column("cells")
                owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                real = np.zeros((n, CLASSES))
                real[owner, flat.field("cls").to_numpy()] = flat.field("n").to_numpy()
                c = of_class[place]
                vectors = np.zeros((n, SIZE + 1))
                t = np.flatnonzero(kind == TARGET)
                if len(t):
                    share = counts[place[t]] / total[c[t]]
                    theta = fit_words(real[t], NOISE * pairs[:, c[t]].T * share[:, None], np.full((len(t), 1), -np.log(NOISE)), with_bias)
                    theta[:, -1] += np.log(share)
                    vectors[t] = theta
                k = np.flatnonzero(kind == CONTEXT)
                if len(k):
                    start = (usual[c[k]] + m.r[c[k]] * m.last) @ m.q.T + m.bias - np.log(NOISE * m.noise)
                    vectors[k, :-1] = fit_words(real[k], NOISE * real[k].sum(axis=1, keepdims=True) * m.noise, start, m.q)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (SIZE + 1))
                yield pa.RecordBatch.from_arrays([rows.column("kind"), rows.column("place"), pa.ListArray.from_arrays(offsets, pa.array(vectors.reshape(-1)))], names=["kind", "place", "vector"])

    words = cells.where(F.col("kind") != TRIPLE).select("kind", F.expr(f"cell div {CLASSES}").alias("place"), F.struct((F.col("cell") % CLASSES).cast("int").alias("cls"), "n").alias("c"))
    return in_batches(words.groupBy("kind", "place").agg(F.collect_list("c").alias("cells")), run, "kind int, place long, vector array<double>")


def fit_model(training: DataFrame, counts: DataFrame) -> Model:
    """The model of (text); ``counts`` has (word, c) of its tokens. What reaches the driver is bounded by CLASSES ** 3 and by the vocabulary."""
    n_tokens, n_words = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    end_row = counts.where(F.col("word") == F.lit(END)).first()
    words = counts.where(F.col("word") != F.lit(END))
    least = max(LEAST, int(np.ceil(n_tokens ** (2 / 3) / SHARE)))
    frequent = [(bytes(r["word"]), r["c"]) for r in words.where(F.col("c") >= least).toLocalIterator()]
    vocabulary = Vocabulary.of(frequent, int(n_tokens), int(n_words), int(end_row["c"]) if end_row else 0)
    within = np.full(CLASSES, np.log10(0.5))
    for r in words.where(F.col("c") < least).groupBy(_shape_column("word").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        within[r["k"]] = np.log10(r["n"] + 0.5 * (r["v"] + 1))

    cells = cut(_count_cells(training, vocabulary), "cells")
    triples = np.zeros(CLASSES**3)
    found = cells.where(F.col("kind") == TRIPLE).select("cell", "n").toPandas()
    triples[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    triples = triples.reshape(CLASSES, CLASSES, CLASSES)
    classes = train_log_bilinear(triples)
    context, target = np.zeros((len(frequent), SIZE)), np.zeros((len(frequent), SIZE + 1))
    for r in _fit_vectors(cells, classes, triples.sum(axis=0), vocabulary).toLocalIterator():
        if r["kind"] == TARGET:
            target[r["place"]] = r["vector"]
        else:
            context[r["place"]] = r["vector"][:-1]
    drop_paths(training.sparkSession, cells)
    return Model.of(vocabulary, classes, context, target, within)


def score_texts(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text).

    Tokens are words between ASCII white space, A-Z in lower case, and one end. The model learns from the rows that are
    not held out. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score is the model's log10
    probability of the text. n_known counts tokens seen in training, train_tokens is N.

    Nulls: a null text is an empty one, just an end; a null doc_id is not held out. Repeated rows count, and are
    scored, each. Texts are read whole. Without training rows N is 0 and nothing is known. An empty table
    gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", (held_out_column() if held_out is None else held_out).alias("held_out"))
    training = texts.where(~F.col("held_out")).select("text")
    counts = cut(in_batches(training, _count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    model = fit_model(training, counts)
    shipped = spark.sparkContext.broadcast(model)

    def score(batches: Batches) -> Batches:
        m = shipped.value
        v = m.vocabulary
        log_frequent, log_end = np.log10(v.counts + 0.5), np.log10(v.end_count + 0.5)
        part, number = TaskContext.get().partitionId(), 0
        for rows, s in _groups(batches):
            hashes = s.hashes()
            place = v.places(s, hashes)
            t = tokens_of(s, place, v)
            n, often = s.n_docs, place >= 0
            model = np.bincount(t.doc, weights=m.logs(t), minlength=n)
            base = np.bincount(s.doc[often], weights=log_frequent[place[often]], minlength=n) + log_end
            group = part << 32 | number
            number += 1
            none = lambda m, kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int16)), rows.column("doc_id"), rows.column("held_out"), pa.array(s.counts() + 1, pa.int64()),
                    pa.array(np.bincount(s.doc[often], minlength=n) + (v.end_count > 0), pa.int64()), pa.array(base), pa.array(model), none(n, pa.binary()), none(n, pa.list_(pa.int16())),
                ],
                names=_NAMES,
            )
            first, which = distinct(s, hashes, np.flatnonzero(~often))
            if len(first):
                order = np.argsort(which, kind="stable")
                ends = np.cumsum(np.bincount(which, minlength=len(first)))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(s.doc[np.flatnonzero(~often)[order]].astype(np.int16)))
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group] * k, pa.int64()), none(k, pa.int16()), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.int64()),
                        none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64()), _words(s, first), lists,
                    ],
                    names=_NAMES,
                )

    schema = "grp long, ord short, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, word binary, docs array<short>"
    scored = cut(in_batches(texts.withColumn("doc_id", F.col("doc_id").cast("long")), score, schema), "scored")
    rare = scored.where("word IS NOT NULL").select("grp", "word", "docs").join(counts, "word", "left")
    rare = rare.select("grp", F.explode("docs").alias("ord"), F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)).alias("log"), F.when(F.col("c") > 0, 1).otherwise(0).alias("known"))
    sums = rare.groupBy("grp", "ord").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
    out = scored.where("word IS NULL").drop("word", "docs").join(sums, ["grp", "ord"], "left")
    log = F.coalesce("log", F.lit(0.0))
    v = model.vocabulary
    divisor = float(np.log10(v.n_tokens + 0.5 * (v.n_words + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), (F.col("model") + log).alias("score"),
    )


_NAMES = ["grp", "ord", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "word", "docs"]


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return score_texts(documents(spark, sf_dir))
