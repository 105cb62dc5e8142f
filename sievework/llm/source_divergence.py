"""Audit of how far the sources of a language are apart in their terms, by chi-squared distances of smoothed shares.

Terms whose counts by source are the same in all places add the same to every sum, so terms are grouped by their sparse vector of counts; pairs of sources
are looked at once for each distinct vector and multiplied by its number of terms. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.session import Batches, broadcast_if_small, cut, documents, drop_paths, in_batches
from sievework.llm.tallies import Words, codes, counted, scans
from sievework.llm.wordscan import byte_table

#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 3
#: Shares are counted in parts of this.
PARTS = 1_000_000_000
#: Terms listed for each group.
LISTED = 200

#: Words of ASCII letters and non-ASCII bytes, A-Z in lower case.
LETTERS = byte_table(None, bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))


def _count_terms(batches: Batches) -> Batches:
    """(lang, source, term, n, docs) of runs of texts."""
    for rows, _, s in scans(batches, LETTERS):
        if not len(s.start):
            continue
        lang, langs = codes(rows.column("lang"))
        source, sources = codes(rows.column("source"))
        words = Words.of_scan(s)
        n_words, of = words.numbered(np.arange(len(s.start)))
        own = lang[s.doc] * len(sources) + source[s.doc]
        first, n, which, _ = counted(own * n_words + of)
        # of the words of a text, which come together, one of each
        each, _, _, _ = counted(s.doc * n_words + of)
        docs = np.bincount(which[each], minlength=len(first))
        group = own[first]
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), words.strings(first, first), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )


def share(count: Column, size: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / size), exact whatever the counts."""
    return F.lit(1) + _div((count + 1).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)"), size.cast("decimal(20,0)"))


def _div(a: Column, b: Column) -> Column:
    """Whole division of numbers that are not negative."""
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); shares have ten digits at most, so the square fits into 64 bits."""
    return _div((p - q) * (p - q), q)


def terms_of(docs: DataFrame) -> DataFrame:
    """(lang, term, n, by_source): the kept terms of each language, their occurrences, and these by source as ascending (source, n)."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")))
    rows = in_batches(texts, _count_terms, "lang string, source string, term string, n long, docs long")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return terms.where(F.col("docs") >= LEAST_DOCS).drop("docs")


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) that occurs.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the sum over all kept terms of floor((p - q) ** 2 / q), p and q the shares of
    a term in ``source`` and in ``item``; all ranks. Part ``term``: ``item`` is each kept term that the group has and that has a larger share there than in
    the language, ``value`` the same with q the share in the language; the first LISTED ranks. A share is 1 + floor(10^9 (count + 1) / (N + V)), N a
    group's occurrences of kept terms and V the kept terms of its language. Ranks are by value downward, then by item.

    Nulls: a null text has no terms; null lang or source is the empty string, a group like others. Terms that fewer than three rows of the
    language have are not kept, so repeated rows count each. Texts are read whole. A language with one source has no pairs. An empty table gives an
    empty table. Columns but text, lang and source are not read.
    """
    spark = docs.sparkSession
    terms = cut(terms_of(docs), "terms")
    vectors = cut(terms.groupBy("lang", "by_source").agg(F.count("*").alias("m")).withColumn("vector", F.monotonically_increasing_id()), "vectors")
    cells = vectors.select("lang", "vector", "m", F.explode("by_source").alias("c")).select("lang", "vector", "m", "c.source", "c.n")

    totals = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("N"))
    kept = vectors.groupBy("lang").agg(F.sum("m").alias("V"))
    named = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(totals, ["lang", "source"], "left").join(broadcast_if_small(kept), "lang", "left")
    groups = groups.select("lang", "source", (F.coalesce("N", F.lit(0)) + F.coalesce("V", F.lit(0))).alias("size"), F.coalesce("V", F.lit(0)).alias("V"))
    # without kept terms nothing is shared out
    groups = groups.withColumn("p0", F.when(F.col("V") > 0, share(F.lit(0), F.greatest("size", F.lit(1)))).otherwise(0))
    groups = cut(groups, "groups")
    sized = broadcast_if_small(groups.where("V > 0"))
    cells = cut(cells.join(sized.drop("V"), ["lang", "source"]).select("lang", "vector", "m", "source", share(F.col("n"), F.col("size")).alias("p"), "p0"), "cells")

    # every pair of sources, as if no source had any term; then what differs from it: terms of one of both, by shares; and terms of both, by vectors
    a, b = (groups.select("lang", F.col("source").alias(f"{x}"), F.col("p0").alias(f"{x}0"), *(["V"] if x == "a" else [])) for x in "ab")
    b = broadcast_if_small(b)
    base = a.join(b, "lang").where("a != b").select("lang", "a", "b", F.when(F.col("V") > 0, F.col("V") * distance(F.col("a0"), F.greatest("b0", F.lit(1)))).otherwise(0).alias("value"))
    shares = cut(cells.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m")), "shares")
    one = shares.select("lang", F.col("source").alias("x"), "p", "p0", "m").join(b.select("lang", F.col("b").alias("y"), F.col("b0").alias("q0")), "lang").where("x != y")
    none = lambda p, q: distance(F.col(p), F.col(q))
    forth = one.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("m") * (none("p", "q0") - none("p0", "q0"))).alias("value"))
    back = one.select("lang", F.col("y").alias("a"), F.col("x").alias("b"), (F.col("m") * (none("q0", "p") - none("q0", "p0"))).alias("value"))
    both = _both(cells)
    summed = base.union(forth.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).union(back.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).union(both)
    pairs = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    of_lang = terms.groupBy("lang").agg((F.sum("n") + F.count("*")).alias("whole"))
    each = terms.join(broadcast_if_small(of_lang), "lang").select("lang", "term", share(F.col("n"), F.col("whole")).alias("q"), F.explode("by_source").alias("c"))
    each = each.select("lang", "term", "q", "c.source", "c.n").join(sized.select("lang", "source", "size"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))
    each = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), none("p", "q").alias("value"))
    listed = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED)
    out = cut(pairs.union(listed), "divergence")
    drop_paths(spark, terms, vectors, groups, cells, shares)
    return out


def _both(cells: DataFrame) -> DataFrame:
    """(lang, a, b, value): over the terms that both sources have, the distances less what was added for them by shares, each pair once for a vector.

    A vector's pairs are summed where the vector is, so a task hands on one row for each pair of sources and batch.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("cells")
            if not len(lists):
                continue
            lang, langs = codes(batch.column("lang"))
            sizes, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
            source, sources = codes(flat.field("source"))
            p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            m = batch.column("m").to_numpy()
            # element by element the first of a pair, and for each of these all elements of its vector as the second
            owner = np.repeat(np.arange(len(sizes)), sizes)
            begin, wide = (np.cumsum(sizes) - sizes)[owner], sizes[owner]
            sums: dict[int, int] = {}
            for x in _chunks(wide):
                k = wide[x]
                i = np.repeat(np.arange(x.start, x.stop), k)
                j = np.repeat(begin[x] - (np.cumsum(k) - k), k) + np.arange(len(i))
                apart = i != j
                i, j = i[apart], j[apart]
                row = owner[i]
                f = lambda u, v: (u - v) ** 2 // v
                value = m[row] * (f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j]))
                key = (lang[row] * len(sources) + source[i]) * len(sources) + source[j]
                found, which = np.unique(key, return_inverse=True)
                total = np.zeros(len(found), dtype=np.int64)
                np.add.at(total, which, value)
                for c, v in zip(found.tolist(), total.tolist(), strict=True):
                    sums[c] = sums.get(c, 0) + v
            keys = np.array(list(sums), dtype=np.int64)
            take = lambda of, c: of.take(pa.array(c))
            yield pa.RecordBatch.from_arrays(
                [take(langs, keys // len(sources) ** 2), take(sources, keys // len(sources) % len(sources)), take(sources, keys % len(sources)), pa.array(list(sums.values()), pa.int64())],
                names=["lang", "a", "b", "value"],
            )

    many = cells.groupBy("lang", "vector", "m").agg(F.collect_list(F.struct("source", "p", "p0")).alias("cells")).where(F.size("cells") > 1)
    return in_batches(many.select("lang", "m", "cells"), run, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _chunks(sizes: np.ndarray, limit: int = 1_000_000):
    """Runs of rows whose sizes sum to ``limit`` at most, or one row."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + limit, side="right")))
        yield slice(i, j)
        i = j


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its most peculiar terms."""
    return source_divergence(documents(spark, sf_dir))


#: DuckDB SQL for the same rows, over every kept term by itself.
SQL_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
g AS (
  SELECT k.lang, k.source, coalesce(sum(c.n) FILTER (WHERE t.term IS NOT NULL), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) k
  LEFT JOIN c ON c.lang = k.lang AND c.source = k.source LEFT JOIN kept t ON t.lang = c.lang AND t.term = c.term GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // CAST(g.n + v.v AS HUGEINT) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (t.n + 1)) // CAST(v.n + v.v AS HUGEINT) AS HUGEINT) AS q
  FROM g JOIN v USING (lang) JOIN kept t ON t.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
