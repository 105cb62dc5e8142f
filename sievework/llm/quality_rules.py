"""Quality rules with thresholds from mergeable quantile sketches of each language and source.

Everything here is DataFrame expressions: a text's figures are computed inside its row, sketches are rows of
bucket counts, and merging sketches is adding counts. No cutoff is fixed but the base rule's: all fences are quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.session import broadcast_if_small, cut, documents, unused_names

#: Words of a window that is looked for again in its text.
WINDOW = 8
#: A sketch has LOG_STEPS buckets for each factor e of a value, so a quantile is right within one part in a hundred.
LOG_STEPS = 100
#: Hundredths of a sketch from which its fences are drawn: below the middle, the middle, above it.
LOW, MID, HIGH = 10, 50, 90
#: A fence lies beyond the outer quantile by so many times its distance from the middle, downward and upward.
DOWN, UP = 4, 2
#: A group's sketch is merged with so many documents' worth of its language's, and that with as much of all: the more documents a group
#: has, the more its own count.
PRIOR = 100
METRICS = ["m_length", "m_symbols", "m_lines", "m_repeat"]

_SPACE = r"[\x20\x09-\x0D]+"


def _get(array: Column, i: Column) -> Column:
    return F.get(array, i)


def text_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text`` (columns of those names are replaced).

    Windows are compared by a 64-bit hash within their text. A null or empty text has 0 in all. Other columns stay, whatever their names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = docs.drop(*made)
    hashes, lines, ordered, places = unused_names(d, "hashes", "lines", "ordered", "places")
    text = F.coalesce("text", F.lit(""))
    d = d.withColumns(
        {
            hashes: F.transform(F.filter(F.split(text, _SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)),
            lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "word_chars": F.length(F.regexp_replace(text, _SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    d = d.withColumns({"n_words": F.size(hashes).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}).drop(lines)
    # hashes of runs of 2, 4 and 8 words, each from two of half the length
    for half in (1, 2, 4):
        n = F.size(hashes) - half
        longer = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, half + 1, n), lambda a, b: F.xxhash64(a, b))
        d = d.withColumn(hashes, F.when(n > 0, longer).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    d = d.withColumn(ordered, F.when(some, F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(hashes)

    def again(x: Column, i: Column) -> Column:
        near = F.col(ordered)
        before, after = F.get(near, i - 1)["h"], F.get(near, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    d = d.withColumn(places, F.array_sort(F.transform(F.filter(ordered, again), lambda x: x["i"]))).drop(ordered)
    # windows at these places cover up to the next place, eight words at most
    covered = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(F.col(places), i + 1) - p), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0), lambda a, b: a + b)
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop(places)


def _metrics(d: DataFrame) -> DataFrame:
    """Sketch buckets of each document's mean word length, and of its symbols a character, repeated lines a word and repeated words a word.

    Half a case is added to what is counted, so a text without any has the rate that its length can tell, and quantiles of a group
    where most texts have none still differ.
    """
    rate = lambda n, of: (F.col(n) + F.lit(0.5)) / (F.col(of) + F.lit(1))
    values = {
        "m_length": (F.col("word_chars") + F.lit(0.5)) / F.greatest("n_words", F.lit(1)),
        "m_symbols": rate("n_symbols", "word_chars"), "m_lines": rate("n_dup_lines", "n_words"), "m_repeat": rate("n_repeat_words", "n_words"),
    }
    return d.withColumns({k: F.floor(F.log(v) * LOG_STEPS).cast("long") for k, v in values.items()})


def sketches(d: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, bucket, n): the sketch of each metric of each group, from documents or from finer sketches."""
    if "bucket" in d.columns:
        return d.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("bucket")) for m in METRICS)))
    return d.select(*keys, pairs.alias("p")).groupBy(*keys, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merged(own: DataFrame, wider: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """The sketches ``own`` of groups ``keys``, each merged with PRIOR documents' worth of the sketch of its wider group ``on``.

    The counts are whole numbers, held as doubles, in proportion to the merged shares.
    """
    over = Window.partitionBy(*keys, "metric")
    own = own.withColumns({"n": F.col("n").cast("double"), "size": F.sum("n").over(over).cast("double")})
    total = wider.groupBy(*on, "metric").agg(F.sum("n").cast("double").alias("wide_size"))
    groups = own.groupBy(*keys, "metric").agg(F.max("size").alias("size")).join(total, [*on, "metric"])
    spread = groups.join(wider.select(*on, "metric", "bucket", F.col("n").cast("double").alias("wide")), [*on, "metric"])
    both = spread.join(own.select(*keys, "metric", "bucket", "n"), [*keys, "metric", "bucket"], "left")
    return both.select(*keys, "metric", "bucket", (F.coalesce("n", F.lit(0.0)) * F.col("wide_size") + F.lit(float(PRIOR)) * F.col("wide")).alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, low, mid, high): the buckets in which each sketch reaches its LOW, MID and HIGH hundredths."""
    over = Window.partitionBy(*keys, "metric")
    d = sketch.withColumns({"up_to": F.sum("n").over(over.orderBy("bucket")), "size": F.sum("n").over(over)})
    reach = lambda q: F.min(F.when(F.col("up_to") * 100 >= F.col("size") * q, F.col("bucket")))
    return d.groupBy(*keys, "metric").agg(reach(LOW).alias("low"), reach(MID).alias("mid"), reach(HIGH).alias("high"))


def fences(d: DataFrame) -> DataFrame:
    """(lang, source, metric, at_least, at_most) for every group of the documents, in buckets; lang and source have no nulls.

    Every figure comes from the group's sketch, merged with its language's and that of all by their sizes: at_most lies UP times the distance
    from MID to HIGH beyond HIGH, at_least (of the mean word length only) DOWN times that from LOW to MID below LOW.
    """
    fine = cut(sketches(d, "lang", "source"), "sketches")
    by_lang, all_ = sketches(fine, "lang"), sketches(fine)
    middle = cut(merged(by_lang, all_, [], ["lang"]), "sketches")
    q = quantiles(merged(fine, middle, ["lang"], ["lang", "source"]), "lang", "source")
    least = F.when(F.col("metric") == "m_length", F.col("low") - DOWN * (F.col("mid") - F.col("low")))
    return q.select("lang", "source", "metric", least.alias("at_least"), (F.col("high") + UP * (F.col("high") - F.col("mid"))).alias("at_most"))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each document.

    base_failed: under 20 words, or over 30 of 100 words in repeated windows. Else a document is kept if its mean word
    length, symbols, repeated lines and repeated words lie within the fences of its language and source, which the documents that
    pass the base rule make.

    Nulls: a null text has no words, so it fails; null language or source is a group like others. Repeated rows are judged
    each and count each. An empty table gives an empty table. Other columns are not read.
    """
    d = text_figures(docs.select("doc_id", "text", "lang", "source")).drop("text")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    named = {c: F.coalesce(c, F.lit("\1")) for c in ("lang", "source")}
    d = cut(_metrics(d.withColumns({"base_failed": failed, **named})), "figures")
    f = fences(d.where("NOT base_failed"))
    wide = f.groupBy("lang", "source").agg(*(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("at_least", "at_most")))
    d = d.join(broadcast_if_small(cut(wide, "fences"), 200_000), ["lang", "source"], "left")
    inside = F.col("m_length") >= F.col("m_length_at_least")
    for m in METRICS:
        inside &= F.col(m) <= F.col(f"{m}_at_most")
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's figures and verdict."""
    return judged(documents(spark, sf_dir))


#: DuckDB SQL for the same rows.
SQL_OP3 = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, lang, source, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws,
    length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM base),
win AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM parts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
fig AS (
  SELECT p.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM parts p LEFT JOIN rep ON rep.r = p.r),
bad AS (SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, coalesce(lang, chr(1)) AS g, coalesce(source, chr(1)) AS h FROM fig),
long AS (
  SELECT r, g, h, base_failed, 'm_length' AS metric, (word_chars + 0.5::DOUBLE) / greatest(n_words, 1) AS v FROM bad UNION ALL
  SELECT r, g, h, base_failed, 'm_symbols', (n_symbols + 0.5::DOUBLE) / (word_chars + 1) FROM bad UNION ALL
  SELECT r, g, h, base_failed, 'm_lines', (n_dup_lines + 0.5::DOUBLE) / (n_words + 1) FROM bad UNION ALL
  SELECT r, g, h, base_failed, 'm_repeat', (n_repeat_words + 0.5::DOUBLE) / (n_words + 1) FROM bad),
b AS (SELECT r, g, h, metric, base_failed, CAST(floor(ln(v) * 100) AS BIGINT) AS bucket FROM long),
own AS (SELECT g, h, metric, bucket, count(*)::DOUBLE AS n FROM b WHERE NOT base_failed GROUP BY ALL),
mid AS (SELECT g, metric, bucket, sum(n) AS n FROM own GROUP BY ALL),
al AS (SELECT metric, bucket, sum(n) AS n FROM own GROUP BY ALL),
als AS (SELECT metric, sum(n) AS size FROM al GROUP BY ALL),
mix AS (
  SELECT k.g, a.metric, a.bucket, coalesce(m.n, 0) * s.size + 100 * a.n AS n FROM al a JOIN als s USING (metric) CROSS JOIN (SELECT DISTINCT g FROM own) k
  LEFT JOIN mid m ON m.g = k.g AND m.metric = a.metric AND m.bucket = a.bucket),
mixs AS (SELECT g, metric, sum(n) AS size FROM mix GROUP BY ALL),
whole AS (
  SELECT k.g, k.h, x.metric, x.bucket, coalesce(o.n, 0) * s.size + 100 * x.n AS n FROM mix x JOIN mixs s USING (g, metric) JOIN (SELECT DISTINCT g, h FROM own) k ON k.g = x.g
  LEFT JOIN own o ON o.g = k.g AND o.h = k.h AND o.metric = x.metric AND o.bucket = x.bucket),
upto AS (SELECT *, sum(n) OVER (PARTITION BY g, h, metric ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY g, h, metric) AS t FROM whole),
q AS (SELECT g, h, metric, min(bucket) FILTER (WHERE u * 100 >= t * 10) AS low, min(bucket) FILTER (WHERE u * 100 >= t * 50) AS mid, min(bucket) FILTER (WHERE u * 100 >= t * 90) AS high FROM upto GROUP BY ALL),
ok AS (
  SELECT r, bool_and(bucket <= high + 2 * (high - mid) AND (metric <> 'm_length' OR bucket >= low - 4 * (mid - low))) AS inside FROM b JOIN q USING (g, h, metric) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND inside, false) AS kept FROM bad LEFT JOIN ok USING (r)
"""
