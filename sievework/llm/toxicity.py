"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks, trained on sentences of labelled documents.

The kernel of two units (words without punctuation) is the gap-weighted subsequence kernel: over all strings of three bytes, the product of their weights
in both units, where a string weighs DECAY to the power of the least bytes that it spans as a subsequence. The beginning of a word
counts as a byte, so a stem is told from the same letters inside a word. A unit with bytes put in between keeps its subsequences, at less weight. Words of a letter or two in a row, as in ``a b c d``, are one unit too. The kernel of two sentences sums
a power of it over their distinct units, so the machine's decision for a sentence is a sum over its units, and a document's is that of its highest sentence.

A document's label says nothing about which sentence earns it. Landmarks are strings of which toxic sample documents have many more than others, taken
until they cover the toxic ones; sentences with one are positive, those of other documents negative. The first machine then picks the sentence of each
uncovered toxic document that comes nearest, and the second is trained with these.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.session import Batches, documents, in_batches, table
from sievework.llm.tallies import gathered
from sievework.llm.wordscan import SPACED, Scan, mix, scan, text_slices

#: Labelled documents of each label on which the machine is fitted, at most, whole and of so many bytes at most.
SAMPLE, SAMPLE_BYTES = 1200, 20_000
#: Weight of a byte spanned, and the power of the kernel.
DECAY, POWER = 0.75, 3
#: Bytes of a unit; a longer word is several, each half a unit on. Words of a sentence; a longer one is cut.
UNIT, SENTENCE = 16, 40
#: What stands for a word's beginning, and the bytes of a unit with it.
HEAD, WIDE = 1, UNIT + 1
#: Landmarks: strings of toxic documents and words of others; bytes of such strings.
TOXIC_MARKS, OTHER_MARKS, MARK_SIZES = 48, 48, (8, 7, 6, 5, 4)
#: A longer string is taken in place of one inside it that tells more, but not by more than this share.
NEARLY = 0.9
#: Sentences on which the machine is trained, of either kind, at most, the pull of its weights to 0, and the weight of all positive ones against that of all others.
TRAINED, PULL, BALANCE = 10_000, 0.02, 0.3
#: Units of each string that are trained alone.
ALONE = 40
#: Bytes of text scored together, and units whose values a worker remembers.
GROUP_BYTES, REMEMBERED = 3_000_000, 1_000_000

_U = np.uint64
_DROPPED = np.zeros(256, dtype=bool)
_DROPPED[[HEAD, *(c for c in range(0x21, 0x7F) if not chr(c).isalnum())]] = True
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


@dataclass
class Units:
    """Units of some texts: bytes, where each begins and ends, whether a word begins there, its hash, its text and its sentence (ascending; a sentence is of one text)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    head: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    n_docs: int

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """The bytes of units, behind HEAD where a word begins, padded with 0 to WIDE."""
        head = self.head[at][:, None]
        places = self.start[at][:, None] + np.arange(WIDE) - head
        out = np.where(places < self.end[at][:, None], self.data[np.clip(places, 0, max(len(self.data) - 1, 0))], 0).astype(np.uint8)
        out[self.head[at], 0] = HEAD
        return out


def units_of(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words of texts without punctuation, cut where they are long, and runs of three or more words of a byte or two as one more unit."""
    n = len(data)
    after = np.ones(n, dtype=bool)
    after[:-1] = _SPACE[data[1:]]
    after[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] <= n)] - 1] = True
    ends = (np.isin(data, list(b".!?")) & after) | (data == 0x0A)
    past = np.cumsum(ends) - ends
    keep = ~_DROPPED[data]
    upto = np.append(0, np.cumsum(keep))
    s = scan(data[keep], upto[offsets], SPACED)
    of_text = past[keep]
    sentence = of_text[s.start] if len(s.start) else s.start
    start, end, doc = s.start, s.end, s.doc
    # sentences are numbered anew with each text, and after SENTENCE words
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0)) if len(start) else start
    place = np.arange(len(start)) - first
    number = np.cumsum(fresh | (place % SENTENCE == 0)) - 1

    # runs of short words, joined in a buffer behind the texts
    short = (end - start <= 2) & (place % SENTENCE != 0) if len(start) else fresh
    short_first = (end - start <= 2) & (place % SENTENCE == 0)
    run = np.cumsum(~short)  # a run goes on with each short word that is not its sentence's first
    begins = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(start) else start
    length = np.diff(np.append(begins, len(start)))
    head = np.where(short_first[begins], begins, begins + 1) if len(begins) else begins
    length = length - (head - begins)
    some = length >= 3
    head, length = head[some], length[some]
    many = np.repeat(head - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    size = end[many] - start[many]
    flat = np.repeat(start[many] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    joined = np.add.reduceat(size, np.cumsum(length) - length) if len(head) else size
    base = len(s.data)
    buffer = np.concatenate([s.data, s.data[flat]])
    extra = base + np.cumsum(joined) - joined
    start, end = np.concatenate([start, extra]), np.concatenate([end, extra + joined])
    doc, number = np.concatenate([doc, doc[head]]), np.concatenate([number, number[head]])

    # units of UNIT bytes at most
    step = UNIT // 2
    pieces = 1 + np.maximum(0, -(-(end - start - UNIT) // step))
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, last = np.repeat(start, pieces) + k * step, np.repeat(end, pieces)
    end = np.minimum(start + UNIT, last)
    order = np.argsort(np.repeat(number, pieces), kind="stable")
    start, end, begun = start[order], end[order], (k == 0)[order]
    doc, number = np.repeat(doc, pieces)[order], np.repeat(number, pieces)[order]
    hashes = Scan(buffer, offsets, start, end, doc, s.n_docs).hashes()
    with np.errstate(over="ignore"):
        hashes = np.where(begun, hashes, mix(hashes ^ _U(0xA0761D6478BD642F)))
        once = np.unique(hashes ^ mix(number.astype(_U) + _U(1)), return_index=True)[1]
    once.sort()
    return Units(buffer, start[once], end[once], begun[once], hashes[once], doc[once], number[once], s.n_docs)


#: Places of three bytes in a unit, the widest first, and their weights.
_TRIPLES = np.array(sorted(combinations(range(WIDE), 3), key=lambda x: x[0] - x[2]))
_WEIGHTS = (DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1.0)).astype(np.float32)


@dataclass
class Kernel:
    """Subsequence kernels with the landmarks, a matrix of bytes padded with 0: the subsequences of three bytes that these have, by number, and their weights."""

    marks: np.ndarray
    letter: np.ndarray  # for each byte its number among those of the landmarks, or 0
    known: np.ndarray  # for each three letters the number of the subsequence, or one more than there are
    weight: np.ndarray  # (subsequence, landmark)
    scale: np.ndarray  # each landmark's kernel with itself

    @staticmethod
    def of(marks: np.ndarray) -> Kernel:
        used = np.setdiff1d(np.unique(marks), [0])
        letter = np.zeros(256, dtype=np.int32)
        letter[used] = np.arange(1, len(used) + 1)
        base = len(used) + 1
        blank = Kernel(marks, letter, np.zeros(base**3, dtype=np.int32), np.zeros((0, 0)), np.zeros(0))
        codes = [np.where((t := letter[marks[:, p]]).all(axis=1), (t[:, 0] * base + t[:, 1]) * base + t[:, 2], -1) for p in _TRIPLES]
        found = np.setdiff1d(np.unique(np.concatenate(codes)), [-1])
        blank.known[:] = len(found)
        blank.known[found] = np.arange(len(found))
        weight = blank._subsequences(marks, len(found)).T.copy()
        return Kernel(marks, letter, blank.known, weight, np.maximum((weight**2).sum(axis=0), 1e-12))

    def _subsequences(self, matrix: np.ndarray, n: int) -> np.ndarray:
        """The weights of the known subsequences in each unit."""
        letters = self.letter[matrix.T]
        base = int(self.letter.max()) + 1
        out = np.zeros((len(matrix), n + 1), dtype=np.float32)
        flat, row = out.reshape(-1), np.arange(len(matrix)) * (n + 1)
        longest = int((matrix != 0).sum(axis=1).max(initial=0))
        for (i, j, k), w in zip(_TRIPLES.tolist(), _WEIGHTS.tolist(), strict=True):
            if k < longest:  # nearer places come later and have more weight
                flat[row + self.known[(letters[i] * base + letters[j]) * base + letters[k]]] = w
        return out[:, :n]

    def with_marks(self, matrix: np.ndarray) -> np.ndarray:
        """The kernel of each unit of a matrix with each landmark, divided by the landmark's own, to the POWER."""
        out = np.zeros((len(matrix), len(self.marks)), dtype=np.float32)
        order = np.argsort((matrix != 0).sum(axis=1), kind="stable")
        for i in range(0, len(order), 4096):
            part = order[i : i + 4096]
            out[part] = self._subsequences(matrix[part], len(self.weight)) @ self.weight
        return (out / self.scale) ** POWER


@dataclass
class Machine:
    """A trained machine: a unit adds ``alpha`` . kernels to its sentence, which starts from ``bias``; ``slope`` and ``middle`` make a share of the highest sentence."""

    kernel: Kernel
    alpha: np.ndarray
    bias: float
    slope: float
    middle: float

    def share(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.middle, -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float, logistic: bool = False) -> np.ndarray:
    """Weights and bias (last) of least squared hinge loss, or logistic loss, plus ``pull`` times the squared weights; labels are -1 and 1."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag(np.append(np.full(x.shape[1] - 1, pull), 1e-6))
    w = np.zeros(x.shape[1])
    for _ in range(15):
        margin = y * (x @ w)
        if logistic:
            p = 1 / (1 + np.exp(np.clip(margin, -500, 500)))
            slope, curve = -weight * y * p, weight * p * (1 - p) + 1e-9
        else:
            open_ = margin < 1
            slope, curve = -weight * y * np.where(open_, 1 - margin, 0), weight * open_
        step = np.linalg.solve((x * curve[:, None]).T @ x + ridge, x.T @ slope + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-4 * (1 + np.abs(w).max()):
            break
    return w


def _strings(u: Units, doc_toxic: np.ndarray) -> list[bytes]:
    """Strings that tell toxic sample documents from others, until these are covered by several."""
    n_toxic, n_other = max(int(doc_toxic.sum()), 1), max(int((~doc_toxic).sum()), 1)
    one = np.unique(u.doc.astype(_U) * _U(0x9E3779B97F4A7C15) ^ u.hashes, return_index=True)[1]  # a unit once for each text
    rows = u.matrix(one)
    doc = u.doc[one]
    names, owners = [], []
    for size in MARK_SIZES:
        grams = np.lib.stride_tricks.sliding_window_view(rows, size, axis=1).reshape(-1, size)
        whole = grams[:, -1] != 0
        grams, of = np.ascontiguousarray(grams[whole]), np.repeat(doc, WIDE - size + 1)[whole]
        key = np.zeros((len(grams), 8), dtype=np.uint8)
        key[:, :size] = grams
        key = key.view(np.int64).ravel()
        n_grams = len(np.unique(key))
        # only strings that toxic documents have three times can be taken
        gram, times = np.unique(key[doc_toxic[of]], return_counts=True)
        gram = gram[times >= 3]
        if not len(gram):
            continue
        number = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
        known = gram[number] == key
        pair = np.unique(number[known] * u.n_docs + of[known])
        del grams, key, known
        number, of = pair // u.n_docs, pair % u.n_docs
        toxic = np.bincount(number[doc_toxic[of]], minlength=len(gram))
        other = np.bincount(number[~doc_toxic[of]], minlength=len(gram))
        # in more toxic documents than chance gives to any of so many strings
        share, usual = np.clip(toxic / np.maximum(toxic + other, 1), 1e-9, 1 - 1e-9), n_toxic / (n_toxic + n_other)
        apart = (toxic + other) * (share * np.log(share / usual) + (1 - share) * np.log((1 - share) / (1 - usual)))
        good = np.flatnonzero((toxic >= 3) & (share > usual) & (apart > np.log(n_grams) + 2))
        good = good[np.argsort(-toxic[good], kind="stable")[:4000]]
        chosen = np.isin(number, good)
        by = np.searchsorted(np.sort(good), number[chosen])
        at = len(names)
        for g in np.sort(good).tolist():
            names.append(gram[g : g + 1].view(np.uint8)[:size].tobytes())
        owners.append(np.column_stack([by + at, of[chosen]]))
    if not names:
        return []
    owners = np.concatenate(owners)
    penalty = np.bincount(owners[~doc_toxic[owners[:, 1]], 0], minlength=len(names)) * (n_toxic / n_other) * 4
    links = owners[doc_toxic[owners[:, 1]]]
    # a document counts half as much with each string of it that is taken; strings with four bytes of a taken one in a row are not looked at
    worth, marks, free = np.ones(u.n_docs), [], np.ones(len(names), dtype=bool)
    parts = [{x[i : i + 4] for i in range(len(x) - 3)} for x in names]
    while len(marks) < TOXIC_MARKS and free.any():
        gain = np.where(free, np.bincount(links[:, 0], weights=worth[links[:, 1]], minlength=len(names)) - penalty, -np.inf)
        if gain.max() < 1:
            break
        # of strings as good the longest, then the longest with it in that is nearly as good
        best = max(np.flatnonzero(gain == gain.max()).tolist(), key=lambda i: (len(names[i]), names[i]))
        best = max((i for i in np.flatnonzero(gain >= NEARLY * gain[best]).tolist() if names[best] in names[i]), key=lambda i: (len(names[i]), gain[i], names[i]))
        marks.append(names[best])
        worth[links[links[:, 0] == best, 1]] /= 2
        free &= np.array([not (x & parts[best]) for x in parts])
    return marks


def _padded(strings: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(x[:WIDE].ljust(WIDE, b"\0"), dtype=np.uint8) for x in strings], dtype=np.uint8).reshape(-1, WIDE)


def _stretched(units: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Units with a letter put in somewhere inside."""
    out = units.copy()
    for row in out:
        n = int((row != 0).sum())
        first = 1 + int(row[0] == HEAD)
        if first + 2 <= n < WIDE:
            at = int(rng.integers(first, n))
            row[at + 1 :] = row[at:-1]
            row[at] = rng.integers(0x61, 0x7B)
    return out


def fit_machine(sample: pd.DataFrame, weights: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> Machine | None:
    """The machine of a sample of (text, toxic); ``weights`` say how many documents one of label 0 or 1 stands for. None where one label has no text."""
    toxic = sample["toxic"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    _, _, data, offsets = next(iter(text_slices(pa.array(sample["text"].tolist(), pa.string()), 1 << 40)))
    u = units_of(data, offsets)
    if not len(u.start):
        return None
    strings = _strings(u, toxic)
    hashes, first, which = np.unique(u.hashes, return_index=True, return_inverse=True)
    matrix = u.matrix(first)
    n_sentences = int(u.sentence[-1]) + 1
    sentence_doc = np.zeros(n_sentences, dtype=np.int64)
    sentence_doc[u.sentence] = u.doc

    # words of other documents that look most like the strings, and words at random
    seen_clean = np.zeros(len(hashes), dtype=bool)
    seen_clean[which[~toxic[u.doc]]] = True
    clean = np.flatnonzero(seen_clean & ((matrix != 0).sum(axis=1) >= 4))
    if not strings:  # nothing stands out: words of toxic documents at random
        only = np.flatnonzero(~seen_clean & ((matrix != 0).sum(axis=1) >= 3))
        strings = [matrix[i].tobytes().rstrip(b"\0") for i in rng.permutation(only)[:TOXIC_MARKS].tolist()] or [b"\1\1\1"]
    near = Kernel.of(_padded(strings))
    like = np.zeros(len(clean))
    for i in range(0, len(clean), 50_000):
        like[i : i + 50_000] = near.with_marks(matrix[clean[i : i + 50_000]]).max(axis=1)
    hard = clean[np.argsort(-like, kind="stable")[: OTHER_MARKS // 2]]
    rest = np.setdiff1d(clean, hard)
    chosen = np.concatenate([hard, rng.permutation(rest)[: OTHER_MARKS - len(hard)]])
    words = matrix[chosen]
    words[:, MARK_SIZES[0] :] = 0
    kernel = Kernel.of(np.concatenate([_padded(strings), words]))
    own = kernel.with_marks(kernel.marks)
    own = (own + own.T) / 2
    values, vectors = np.linalg.eigh(own + 1e-3 * np.eye(len(own)))
    root = vectors / np.sqrt(np.maximum(values, 1e-3))  # features of a unit: kernels @ root

    # a string covers a unit if it has it byte by byte
    covers = np.zeros(len(hashes), dtype=bool)
    near_units = []
    for x in strings:
        gram = np.frombuffer(x, dtype=np.uint8)
        has = (np.lib.stride_tricks.sliding_window_view(matrix, len(gram), axis=1) == gram).all(axis=2).any(axis=1)
        covers |= has
        if (of := np.flatnonzero(has & ~seen_clean)).size:
            near_units.append(rng.choice(of, ALONE))
    near_units = np.concatenate(near_units) if near_units else np.zeros(0, dtype=np.int64)
    # some such units of each string also stand alone, as they are and with a letter put in, against the words of other documents that are most like them
    hard = clean[np.argsort(-like, kind="stable")[: TRAINED // 4]]
    hit = np.zeros(n_sentences, dtype=bool)
    hit[u.sentence[covers[which]]] = True
    positive = hit & toxic[sentence_doc]

    kernels = np.zeros((len(hashes), len(own)), dtype=np.float32)
    for i in range(0, len(hashes), 50_000):
        kernels[i : i + 50_000] = kernel.with_marks(matrix[i : i + 50_000])

    begins = np.searchsorted(u.sentence, np.arange(n_sentences + 1))

    def features(at: np.ndarray, kernels: np.ndarray) -> np.ndarray:
        """Features of the sentences ``at``, from those of their units."""
        size = (begins[1:] - begins[:-1])[at]
        first = np.cumsum(size) - size
        units = np.repeat(begins[at] - first, size) + np.arange(int(size.sum()))
        return np.add.reduceat(kernels[which[units]], first, axis=0) @ root

    def decisions(kernels: np.ndarray, alpha: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence, and the highest of each document."""
        each = np.bincount(u.sentence, weights=(kernels @ alpha)[which], minlength=n_sentences) + bias
        highest = np.full(len(sample), -np.inf)
        np.maximum.at(highest, sentence_doc, each)
        return each, np.where(np.isfinite(highest), highest, bias - 1)

    negative = np.flatnonzero(~toxic[sentence_doc])
    negative = rng.permutation(negative)[:TRAINED]
    for _ in range(3):
        x = stretched = None  # those of the turn before go first
        yes = rng.permutation(np.flatnonzero(positive))[:TRAINED]
        if not len(yes):
            yes = np.flatnonzero(toxic[sentence_doc])[:TRAINED]
        stretched = kernels.copy()
        stretched[covers] = kernel.with_marks(_stretched(matrix[covers], rng))
        alone = np.concatenate([kernels[near_units], *(kernel.with_marks(_stretched(matrix[near_units], rng)) for _ in range(3))]) @ root
        x = np.concatenate([features(yes, kernels), features(yes, stretched), alone, features(negative, kernels), kernels[hard] @ root])
        y = np.repeat([1.0, -1.0], [2 * len(yes) + len(alone), len(negative) + len(hard)])
        w = newton(x, y, np.where(y > 0, BALANCE * (y < 0).sum() / (y > 0).sum(), 1.0), PULL)
        alpha, bias = root @ w[:-1], float(w[-1])
        decision, highest = decisions(kernels, alpha, bias)
        # the sentence of an uncovered toxic document that comes nearest, and sentences of other documents that were taken for toxic
        open_ = toxic & ~np.isin(np.arange(len(sample)), sentence_doc[positive]) & (highest > 0)
        positive |= open_[sentence_doc] & (decision == highest[sentence_doc])
        wrong = np.flatnonzero(~toxic[sentence_doc] & (decision > -0.5))
        negative = np.union1d(negative, rng.permutation(wrong)[: TRAINED // 3])
    # half of the weight of a toxic document is that of the same with a letter put into each of its strings
    other = decisions(stretched, alpha, bias)[1][toxic]
    share = np.append(np.where(toxic, weights[1] / 2, weights[0]), np.full(len(other), weights[1] / 2))
    platt = newton(np.append(highest, other)[:, None], np.append(np.where(toxic, 1.0, -1.0), np.ones(len(other))), share, 1e-3, logistic=True)
    return Machine(kernel, alpha, bias, max(float(platt[0]), 0.0), float(platt[1]))


def held_out_column() -> Column:
    """Whether crc32 of doc_id as text leaves 0 by 5; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[pd.DataFrame, tuple[float, float]]:
    """At most SAMPLE training documents of each label as (text, toxic), the first by a hash, and how many documents one of each stands for.

    Rows of one doc_id and text are one document; a doc_id with both labels, and a text over SAMPLE_BYTES, is left out.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    texts = docs.where(~held_out_column() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id", "text")
    counts = {r["toxic"]: r["n"] for r in known.join(texts.select("doc_id"), "doc_id", "left_semi").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts, weights = [], []
    for label in (0, 1):
        n = counts.get(label, 0)
        weights.append(max(n, 1) / max(min(n, SAMPLE), 1))
        mark = F.xxhash64("doc_id")
        # a share of the hashes that has SAMPLE documents, and some more
        near = F.pmod(mark, F.lit(1 << 40)) < int((1 << 40) * min(1.0, (SAMPLE + 4 * SAMPLE**0.5) / max(n, 1)))
        rows = texts.where(near).join(known.where(F.col("toxic") == label), "doc_id").distinct()
        parts.append(rows.orderBy(F.pmod(mark, F.lit(1 << 40)), "doc_id", "text").limit(SAMPLE).toPandas())
    return pd.concat(parts, ignore_index=True)[["text", "toxic"]], (weights[0], weights[1])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text): the share of documents with such a highest sentence that are toxic.

    The machine is fitted on SAMPLE documents of each label whose crc32(doc_id) leaves no 0 by 5 (``held_out`` is false). predicted is 1 from a score of
    0.5 on. Texts are read whole.

    Nulls: a null text, like one without words, has the decision of a sentence without units; a null doc_id is not held out and teaches nothing; null
    labels neither. Repeated rows are scored each and teach once. If one label has no training text, the score is 0 everywhere, or 1 where all are
    toxic. An empty table gives an empty table. Other columns are not read.
    """
    sample, weights = labelled_sample(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(fit_machine(sample, weights))
    constant = float(bool(len(sample)) and bool((sample["toxic"] == 1).all()))
    memory: list[tuple[np.ndarray, np.ndarray]] = []

    def values_of(u: Units, m: Machine) -> np.ndarray:
        """What each unit adds; units met before are looked up."""
        hashes, first, which = np.unique(u.hashes, return_index=True, return_inverse=True)
        known, worth = memory[0] if memory else (np.zeros(0, dtype=_U), np.zeros(0))
        value, new = np.zeros(len(hashes)), np.ones(len(hashes), dtype=bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            new = known[at] != hashes
            value[~new] = worth[at[~new]]
        fresh = np.flatnonzero(new)
        for i in range(0, len(fresh), 50_000):
            value[fresh[i : i + 50_000]] = m.kernel.with_marks(u.matrix(first[fresh[i : i + 50_000]])) @ m.alpha
        if len(known) + len(fresh) > REMEMBERED:
            known, worth, fresh = known[:0], worth[:0], np.arange(len(hashes))
        together, order = np.concatenate([known, hashes[fresh]]), None
        order = np.argsort(together, kind="stable")
        memory[:] = [(together[order], np.concatenate([worth, value[fresh]])[order])]
        return value[which]

    def run(batches: Batches) -> Batches:
        m = shipped.value
        for batch in gathered(batches, GROUP_BYTES):
            for i, n, data, offsets in text_slices(batch.column("text"), 2 * GROUP_BYTES):
                rows = batch.slice(i, n)
                if m is None:
                    score = np.full(n, constant)
                else:
                    u = units_of(data, offsets)
                    highest = np.full(n, m.bias)
                    if len(u.start):
                        decision = np.bincount(u.sentence, weights=values_of(u, m)) + m.bias
                        of = np.zeros(len(decision), dtype=np.int64)
                        of[u.sentence] = u.doc
                        highest[np.unique(u.doc)] = -np.inf
                        np.maximum.at(highest, of, decision)
                    score = m.share(highest)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select("doc_id", "text", held_out_column().alias("held_out"))
    return in_batches(texts, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
