"""Phrases whose words keep together, from exact counts of runs of words in each language.

Runs of one to four words are rows of a table, counted by a hash aggregation of phrase and language. A phrase is as frequent as the phrases in it at
most, so runs of n words become rows only where both runs of n - 1 words in them may be frequent enough. Tasks know these by a bit table of a bounded size, which
says yes to every frequent phrase and now and then to another one; the counts then decide, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.session import Batches, broadcast_if_small, cut, documents, in_batches
from sievework.llm.tallies import Words, chain, codes, counted, scans
from sievework.llm.wordscan import SPACED, Scan

#: Words of a phrase at most, and its occurrences at least.
MAX_WORDS, LEAST = 4, 30
#: A phrase goes if a longer one has so many hundredths of its occurrences.
COVERED = 80
#: Scores are counted in halves of this.
SCALE = 2_000_000
#: Phrases listed for each language.
LISTED = 2000
#: Bits of the table of frequent phrases: sixteen for each, and no more than this power of two (32 MB). With more phrases it says yes more often.
MOST_BITS = 28

#: Bytes of text whose runs are counted together.
GROUP_BYTES = 2_500_000

_U = np.uint64
#: Bytes between words (0), between pieces (1) and in words (2).
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 0
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 1
#: As SPACED, with the ends of pieces between words too.
_PIECES = SPACED.copy()
_PIECES[_KIND == 1] = 0


def _joined(data: np.ndarray, s: Scan) -> np.ndarray:
    """For each word but the last, whether the next one is in the same piece."""
    piece = np.cumsum(_KIND[data] == 1, dtype=np.int32)[s.start]
    return (piece[1:] == piece[:-1]) & (s.doc[1:] == s.doc[:-1])


def _seeds(langs: pa.Array) -> np.ndarray:
    """What the hashes of a language's runs begin from."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], dtype=_U)


def _held(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in the bit table."""
    slot = hashes >> _U(64 - bits)
    return (table[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) != 0


def _runs(batches: Batches, n: int, bits: int, table: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, a) of the runs of ``n`` words whose parts are in the table; of single words all, and the number of words without a phrase."""
    for rows, data, s in scans(batches, _PIECES, GROUP_BYTES):
        if not len(s.start):
            continue
        words = Words.of_scan(s)
        lang, langs = codes(rows.column("lang"))
        h, at = chain(_seeds(langs)[lang][s.doc], words.hashes, 1), np.arange(len(s.start))
        if n > 1:
            joined = _joined(data, s)
            for k in range(2, n):  # hashes of runs of n - 1 words, where there are some
                at = at[at + k - 1 < len(s.start)]
                at = at[joined[at + k - 2]]
                h[at] = chain(h[at], words.hashes[at + k - 1], k)
            has = np.zeros(len(h) + 1, dtype=bool)
            has[at] = _held(table, bits, h[at])
            at = at[has[at] & has[at + 1]]
            at = at[at + n - 1 < len(s.start)]
            at = at[joined[at + n - 2]]
            h[at] = chain(h[at], words.hashes[at + n - 1], n)
        if len(at):
            of = np.unique((at[:, None] + np.arange(n)).reshape(-1)) if n > 1 else at
            many, which = words.numbered(of)
            number = np.zeros(len(s.start), dtype=np.int64)
            number[of] = which
            key = lang[s.doc[at]] * many + number[at]
            for k in range(1, n):
                key = counted(key)[2] * many + number[at + k]
            first, times, _, _ = counted(key)
            first = at[first]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[s.doc[first]])), words.strings(first, first + n - 1), pa.array(times, pa.int64())], names=_NAMES)
        if n == 1:
            total = np.bincount(lang[s.doc], minlength=len(langs))
            yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(total, pa.int64())], names=_NAMES)


_NAMES = ["lang", "phrase", "a"]


def _hash_phrases(batches: Batches) -> Batches:
    """The hashes of phrases (text), as those of runs of words."""
    for rows, _, s in scans(batches, _PIECES, GROUP_BYTES):
        lang, langs = codes(rows.column("lang"))
        counts = s.counts()
        first, hashes = np.cumsum(counts) - counts, s.hashes()
        h = _seeds(langs)[lang]
        for k in range(1, int(counts.max(initial=0)) + 1):
            at = np.flatnonzero(counts >= k)
            h[at] = chain(h[at], hashes[first[at] + k - 1], k)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["hash"])


def bit_table(frequent: DataFrame) -> tuple[int, np.ndarray]:
    """The bits of the hashes of phrases (lang, phrase), made by an aggregation; 32 MB at most reach the driver and the tasks, whatever the number of phrases."""
    bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(16 * frequent.count() + 1)))))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    hashed = in_batches(frequent.select("lang", F.col("phrase").alias("text")), _hash_phrases, "hash long")
    words = hashed.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toPandas()
    table = np.zeros(1 << bits - 6, dtype=_U)
    table[found["at"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(_U)
    return bits, table


def frequent_runs(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a) of the runs of one to ``max_words`` words with ``least`` occurrences or more, (lang, n) of all words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    levels, sizes, bits, shipped = [], None, 0, spark.sparkContext.broadcast(None)
    for n in range(1, max_words + 1):

        def run(batches: Batches, n: int = n, bits: int = bits, shipped=shipped) -> Batches:
            return _runs(batches, n, bits, shipped.value)

        rows = in_batches(texts, run, "lang string, phrase string, a long")
        counts = rows.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        level = cut(counts.where((F.col("a") >= least) | F.col("phrase").isNull()), "runs")
        levels.append(level)
        if n == 1:
            sizes = level.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
        if n < max_words:
            bits, table = bit_table(level.where("phrase IS NOT NULL"))
            shipped = spark.sparkContext.broadcast(table)
    found = levels[0].where("phrase IS NOT NULL").select("lang", "phrase", F.lit(1).alias("words"), "a")
    for n, level in enumerate(levels[1:], 2):
        found = found.union(level.select("lang", "phrase", F.lit(n).alias("words"), "a"))
    return found, sizes


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to ``max_words`` words by score downward, a downward, phrase.

    Words are runs of bytes but space and tab in pieces between ``.,;:!?`` and line ends, A-Z in lower case. ``a`` counts a phrase, ``n`` all words of the
    language. Cut behind its first k words a phrase has l and r, the counts of both parts, and the score floor(2000000 a / (l + r)), in Decimal; the cut of
    least score counts, the first of several. A phrase with 100 f >= 80 a for a longer phrase with it, of f occurrences, goes: as a phrase is as
    frequent as a longer one at least, longer ones by one word decide.

    Nulls: a null text has no words; a null language is ``und``, together with such documents as say so. Repeated rows count each. Texts are read whole;
    a text without words, or an empty table, gives no rows. Columns but text and lang are not read.
    """
    found, sizes = frequent_runs(docs, max_words, least)
    phrases = found.where("words > 1").select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("ws"))
    part = lambda begin, size: F.array_join(F.slice("ws", begin, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", "ws", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    of = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)"), F.col("l").cast("decimal(20,0)") + F.col("r"))
    scored = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    longer = phrases.where("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("f"))
    covered = F.col("f").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    kept = scored.join(longer.withColumnsRenamed({"lang": "g", "phrase": "p"}), (F.col("lang") == F.col("g")) & (F.col("phrase") == F.col("p")) & covered, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
    return ranked.join(broadcast_if_small(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases."""
    return collocations(documents(spark, sf_dir))


#: DuckDB SQL for the same rows, from all runs of words.
SQL_OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
runs AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, i, h.a AS l, t.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (h.a + t.a) AS score FROM (SELECT *, unnest(range(1, words)) AS i FROM c) c
  JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1 : i], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[i + 1 :], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS place FROM cuts),
inner_ AS (SELECT lang, a AS f, array_to_string(ws[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, words - m + 2)) AS i FROM c, (SELECT unnest(range(2, 4)) AS m) WHERE m < words)),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM best b
  WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.f >= 80 * b.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
